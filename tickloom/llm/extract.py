"""Main text of web pages from the standard library's parser events.

The events of a page are streamed into lines: a block element, a line break or a change of the enclosing
section starts a new line. A line has its text, its number of tags, the text inside links and its
enclosing elements. Lines inside menus, headers and footers of the page, sidebars, notices, adverts,
forms, scripts, styles and reader comments are boilerplate. The text-to-tag ratios of all lines are
smoothed by a Gaussian and split in two clusters at a threshold; the upper cluster seeds the content. Each
seed's section (the nearest article or main element) is a content region; on a page without such elements
it is the run from the first seed to the last one and all that shares a container with a seed. All lines of
the region but boilerplate are the page's text, short ones included.

A comment that never ends is dropped; unknown declarations end at the next ">".

Null or empty pages and pages without content give an empty text. Broken markup, unclosed elements and
character references cut at the end are read as far as they go. Repeated rows give equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm import words as W

SIGMA = 1.5  # of the Gaussian, in lines
SHARE = 0.5  # of the smoothed ratios' standard deviation: the clusters' threshold

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea button head title datalist".split())
RAW = frozenset("textarea title iframe".split())  # what looks like a comment in them is text
ASIDE = frozenset("nav aside footer form dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTION = frozenset("article main".split())
BOX = frozenset("div section td body center html".split())
# what an element's opening ends if it is still open
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOTHING: frozenset[str] = frozenset()

# words in class, id or role that mark boilerplate
_MARK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|subscribe|newsletter|"
    r"sidebar\w*|side|aside|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|footnav|masthead|toolbar|"
    r"comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|widget|login|signup|skip|complementary|contentinfo|search|form)(?:$|[\s_-])",
    re.I,
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--(?:!|\s*)>)", re.S)
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Lines of a page: [texts, tags, characters in links, boilerplate, section, container]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # name, and whether it or what it stands in is silent, is boilerplate; section; links around; container
        self.open: list[tuple[str, bool, bool, int, int, int]] = []
        self.lines: list[list] = []
        self.silent = self.aside = False
        self.section = self.sections = self.links = self.box = self.boxes = 0
        self.fresh = True

    def _marked(self, name: str, attrs: list[tuple[str, str | None]]) -> bool:
        if name == "header" and not self.section:
            return True
        if name in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if value and key in ("class", "id", "role") and _MARK.search(_CAMEL.sub("-", value)):
                return True
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
        return False

    def _line(self) -> list:
        if not self.fresh and self.lines:
            last = self.lines[-1]
            if last[3] == self.aside and last[4] == self.section and last[5] == self.box:
                return last
        self.fresh = False
        self.lines.append([[], 0, 0, self.aside, self.section, self.box])
        return self.lines[-1]

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def parse_comment(self, i: int, report: int = 1) -> int:
        if any(x[0] in RAW for x in self.open):
            return i + 4
        end = _COMMENT.match(self.rawdata, i)
        return end.end() if end else len(self.rawdata)  # the whole page was fed: this comment never ends

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # not one of the sections it knows
            return self.parse_bogus_comment(i, 0)

    def _pop(self, to: int) -> None:
        del self.open[to:]
        _, self.silent, self.aside, self.section, self.links, self.box = self.open[-1] if self.open else ("", False, False, 0, 0, 0)

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        block = name in BLOCK
        if block or name in ENDS:
            ended = ENDS.get(name, NOTHING)
            for i in range(len(self.open) - 1, -1, -1):
                at = self.open[i][0]
                if at in ended or at == "p" and name != "br":
                    self._pop(i)
                    break
                if at in BLOCK and at != "p":
                    break
        if block:
            self.fresh = True
        self._line()[1] += 1
        if name in VOID:
            return
        if name in SECTION:
            self.sections += 1
            self.section = self.sections
        if name in BOX:
            self.boxes += 1
            self.box = self.boxes
        self.silent = self.silent or name in SILENT
        self.aside = self.aside or name in ASIDE or bool(attrs or name == "header") and self._marked(name, attrs)
        self.links += name == "a"
        self.open.append((name, self.silent, self.aside, self.section, self.links, self.box))
        if block:
            self.fresh = True

    def handle_endtag(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self._pop(i)
                break
        if name in BLOCK:
            self.fresh = True
        if self.lines:
            self.lines[-1][1] += 1

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        line = self._line()
        line[0].append(data)
        if self.links:
            line[2] += len(data.strip())


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = []
    for texts, tags, links, aside, section, box in parser.lines:
        text = _SPACE.sub(" ", "".join(texts)).strip()
        if text:
            own = 0 if aside else max(len(text) - links, 0)
            lines.append((text, own / max(tags, 1), aside, section, box))
    open_lines = [x for x in lines if not x[2]]
    if not open_lines:
        return ""
    ratios = _smooth(np.array([x[1] for x in lines]), sigma)
    threshold = min(share * float(ratios.std()), float(max(r for r, x in zip(ratios, lines) if not x[2])))
    seeds = [i for i, (r, x) in enumerate(zip(ratios, lines)) if r >= threshold and not x[2]]
    sections = {lines[i][3] for i in seeds if lines[i][3]}
    if sections:
        inside = [x[3] in sections for x in lines]
    else:
        boxes = {lines[i][4] for i in seeds}
        inside = [seeds[0] <= i <= seeds[-1] or x[4] in boxes for i, x in enumerate(lines)]
    return " ".join(x[0] for x, within in zip(lines, inside) if within and not x[2])


def extract(pages: DataFrame, *keep: str | Column, html: str = "html", sigma: float = SIGMA, share: float = SHARE) -> DataFrame:
    """The columns ``keep`` of each page with its main text and the text's code points."""
    narrow = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    kept = [f for f in narrow.schema.fields if f.name != "_html"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string, n_chars long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in W.cuts(batches, "_html"):
            texts = [main_text(h, sigma, share) for h in cut.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*cut.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*cut.schema.names[:-1], "text", "n_chars"]
            )

    return narrow.mapInArrow(run, schema)

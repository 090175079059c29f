"""Quality rules from tokeniser fertility.

Public vocabularies tokenise every word of every whole text. Per text: characters per token of a piece
vocabulary and of a byte-level one, the share of byte-fallback tokens, and the entropy of the text's
pieces. A text outside the bands of its language (else of its script) is rejected.

Texts and languages may be null, texts empty or very long, rows repeated, the table empty; extra columns
pass unseen. A text without words gets zeros, fails the base rules and is not kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm import words as W

REMEMBERED = 600_000  # words whose tokens a worker keeps, eight each on average

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, "
    "chars_per_token double, chars_per_piece double, fallback_share double, entropy double, script string"
)
#: Characters per token and piece without numbers, 0 if more than a quarter of the words are numbers; for the bands only.
PROSE = ("_prose_token", "_prose_piece")
NUMBER = r"^[+(\[]?[0-9][0-9.,:/()\[\]+-]*$"


@dataclass(frozen=True)
class Band:
    """Limits of a language; entropy is relative to the most that as many tokens can have."""

    chars_per_token: tuple[float, float]
    chars_per_piece: tuple[float, float]
    most_fallback: float
    least_entropy: float


@dataclass(frozen=True)
class Rules:
    tokenizers: str = "/opt/tokenizers"
    pieces: str = "piece_bpe_32k.model"
    ranks: str = "byte_bpe_multi_50k.tiktoken"
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))


#: By language, then by script; "" is for all other scripts.
BANDS = {
    "en": Band((1.93, 7.0), (1.72, 6.0), 0.05, 0.40),
    "de": Band((1.87, 7.0), (1.72, 6.0), 0.05, 0.40),
    "fr": Band((1.82, 7.0), (1.68, 6.0), 0.05, 0.40),
    "es": Band((1.84, 7.0), (1.68, 6.0), 0.05, 0.40),
    "latin": Band((1.60, 7.0), (1.50, 6.0), 0.08, 0.40),
    "other": Band((0.20, 7.0), (0.20, 6.0), 0.60, 0.40),
}


class _Vocabularies:
    """Both vocabularies of a worker, with the tokens of the words met last."""

    held: dict[tuple, "_Vocabularies"] = {}

    def __init__(self, rules: Rules):
        import sentencepiece
        import tiktoken

        folder = Path(rules.tokenizers)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=str(folder / rules.pieces))
        self.byte_pieces = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(folder / rules.ranks, "rb"))}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.newline = self.bpe.encode_ordinary("\n")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.counts, self.n_bytes, self.flat = (np.zeros(0, np.int32) for _ in range(4))

    @classmethod
    def of(cls, rules: Rules) -> "_Vocabularies":
        key = (rules.tokenizers, rules.pieces, rules.ranks)
        if key not in cls.held:
            cls.held[key] = cls(rules)
        return cls.held[key]

    def tokens(self, distinct: list[str]) -> np.ndarray:
        """Places in this object's arrays of words as they stand after a space."""
        if len(self.known) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self._forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            pieces = self.sp.encode(new, num_threads=1)
            lengths = np.fromiter(map(len, pieces), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(pieces), np.int32, int(lengths.sum()))
            self.flat = np.concatenate([self.flat, flat])
            # words hold no line feed, so its token parts them
            joined = np.array(self.bpe.encode_ordinary(" " + "\n ".join(new) + "\n"))
            at = np.flatnonzero(joined == self.newline[0])
            counts = np.diff(np.concatenate([[-1], at])) - 1
            n_bytes = _per_text(self.byte_pieces[flat], np.concatenate([[0], np.cumsum(lengths)]))
            for name, each in (("lengths", lengths), ("counts", counts), ("n_bytes", n_bytes)):
                setattr(self, name, np.concatenate([getattr(self, name), each.astype(np.int32)]))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))


def _table(*members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(b"".join(members))] = 1
    return out


_SYMBOL = _table(b"#*$%&|<>")
# first bytes of code points that belong to words
_CHAR = 1 - _table(b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0)))
# letters of Latin script and of others, by first byte
_LATIN = _table(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0xC3, 0xCA)))
_OTHER = _table(bytes(range(0xCA, 0xF8)))


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def _repeated(ends: np.ndarray, codes: np.ndarray, n: int = 8) -> np.ndarray:
    """Per text, the words in ``n``-word windows found twice or more in it; ``n`` is a power of two.

    Windows get exact ranks by doubling: equal ranks mean equal words of the same text.
    """
    size = len(codes)
    if size < n:
        return np.zeros(len(ends) - 1, np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    ranks, width = codes.astype(np.int64), 1
    while width < n:
        pairs = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        if 2 * width == n:  # the last step also tells texts apart, through a second sort key
            order = np.lexsort((owner[: len(pairs)], pairs))
            p, o = pairs[order], owner[: len(pairs)][order]
            fresh = np.concatenate([[True], (p[1:] != p[:-1]) | (o[1:] != o[:-1])])
            ranks = np.empty(len(pairs), np.int64)
            ranks[order] = np.cumsum(fresh) - 1
        else:
            ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    inside = owner[: size - n + 1] == owner[n - 1 :]
    twice = np.bincount(ranks[inside], minlength=1)
    start = np.flatnonzero(inside)
    start = start[twice[ranks[start]] >= 2]
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + n, -1)
    return _per_text(np.cumsum(cover[:-1]) > 0, ends)


def _dup_lines(texts: pa.Array) -> np.ndarray:
    lines = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lines.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    full = worded[codes]
    key = np.unique(owner[full] * (len(worded) + 1) + codes[full])
    return np.bincount(owner[full], minlength=len(texts)) - np.bincount(key // (len(worded) + 1), minlength=len(texts))


def _entropy(ends: np.ndarray, tokens: np.ndarray, most: int) -> np.ndarray:
    """Per text, the entropy in bits of its tokens."""
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n), dtype=np.uint32 if len(n) * most < 1 << 32 else np.uint64), n)
    owner *= owner.dtype.type(most)
    owner += tokens.astype(owner.dtype)
    key = np.sort(owner)
    if not len(key):
        return np.zeros(len(n))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    texts = key[first] // most
    return np.where(n > 0, np.log2(np.maximum(n, 1)) - np.bincount(texts.astype(np.int64), count * np.log2(count), len(n)) / np.maximum(n, 1), 0.0)


def measures(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    v = _Vocabularies.of(rules)
    texts = pc.fill_null(texts, "").cast(pa.string())
    ends, codes, distinct = W.split(texts)
    place = v.tokens(distinct.to_pylist())
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    chars = _per_text(_CHAR[raw], at)
    each = v.lengths[place][codes]
    token_ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    shift = (np.cumsum(v.lengths, dtype=np.int64) - v.lengths)[place][codes] - token_ends[:-1]
    tokens = v.flat[np.repeat(shift, each) + np.arange(token_ends[-1])]
    text_ends = token_ends[ends]
    n_pieces = np.diff(text_ends)
    n_bytes = _per_text(v.n_bytes[place][codes], ends)
    n_bpe = _per_text(v.counts[place][codes], ends)
    latin, other = _per_text(_LATIN[raw], at), _per_text(_OTHER[raw], at)
    # numbers, and the other words of each text
    number = pc.match_substring_regex(distinct, NUMBER).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    n_numbers = _per_text(number, ends)
    chars_in = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    prose = (1 - number) * (4 * n_numbers <= np.diff(ends))[np.repeat(np.arange(len(ends) - 1), np.diff(ends))]
    prose_chars = _per_text(prose * chars_in, ends)
    return {
        "n_words": np.diff(ends),
        "word_chars": chars,
        "n_symbols": _per_text(_SYMBOL[raw], at),
        "n_dup_lines": _dup_lines(texts),
        "n_repeat_words": _repeated(ends, codes),
        "n_tokens": n_bpe,
        "n_byte_tokens": n_bytes,
        "chars_per_token": chars / np.maximum(n_bpe, 1),
        "chars_per_piece": chars / np.maximum(n_pieces, 1),
        "fallback_share": n_bytes / np.maximum(n_pieces, 1),
        "entropy": _entropy(text_ends, tokens, len(v.byte_pieces)) / np.log2(np.clip(n_pieces, 2, len(v.byte_pieces))),
        "script": np.where(other > latin, "other", "latin"),
        "_prose_token": prose_chars / np.maximum(_per_text(prose * v.counts[place][codes], ends), 1),
        "_prose_piece": prose_chars / np.maximum(_per_text(prose * each, ends), 1),
    }


def fertility(docs: DataFrame, *keep: str | Column, text: str | Column = "text", rules: Rules = Rules()) -> DataFrame:
    """The columns ``keep`` of each row and the measures of its text."""
    text = F.col(text) if isinstance(text, str) else text
    narrow = docs.select(*keep, text.cast("string").alias("_text"))
    kept = [f for f in narrow.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [METRICS] + [f"{c} double" for c in PROSE])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in W.cuts(batches, "_text"):
            found = measures(cut.column("_text"), rules)
            yield pa.RecordBatch.from_arrays([*cut.columns[:-1], *map(pa.array, found.values())], [*cut.schema.names[:-1], *found])

    return narrow.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def within_bands(lang: Column, rules: Rules = Rules()) -> Column:
    """Whether the measures lie within the bands of the language, else of the script."""

    def fits(b: Band) -> Column:
        return (
            (F.greatest("chars_per_token", "_prose_token") >= b.chars_per_token[0]) & (F.col("chars_per_token") <= b.chars_per_token[1])
            & (F.greatest("chars_per_piece", "_prose_piece") >= b.chars_per_piece[0]) & (F.col("chars_per_piece") <= b.chars_per_piece[1])
            & (F.col("fallback_share") <= b.most_fallback)
            & (F.col("entropy") >= b.least_entropy)
        )

    name = F.when(lang.isin(*[k for k in rules.bands if k not in ("latin", "other")]), lang).otherwise(F.col("script"))
    verdict = F
    for key, band in rules.bands.items():
        verdict = verdict.when(name == key, fits(band))
    return verdict.otherwise(True)


def quality(docs: DataFrame, *keep: str | Column, text: str | Column = "text", lang: str | Column = "lang", rules: Rules = Rules()) -> DataFrame:
    """``fertility`` with ``base_failed`` and the verdict ``kept``."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    found = fertility(docs, *keep, lang.alias("_lang"), text=text, rules=rules)
    found = found.withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & within_bands(F.col("_lang"), rules)).drop("_lang", *PROSE)

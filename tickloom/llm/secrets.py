"""Secret scans with DataFrame functions alone: fixed patterns and a character Markov model.

Patterns give the base spans (``assign``, ``access``, ``hex``), leftmost and without overlap per kind, of
which those too short are dropped. Two first-order Markov models of characters, one of random strings and
one of ordinary identifiers, are counted from labelled samples; a token whose log-likelihood ratio is high
enough, per transition and in all, is a further span (``random``) unless a base span holds all of it.

The labelled samples are drawn from at most ``SAMPLE`` documents (those of smallest hash): their words,
joined by underscores, mixed case or hyphens as identifiers are, stand for ordinary identifiers; digests
of their words in base 64, letters and digits, or hexadecimal stand for random strings.

A text is searched once for runs of the characters of keys; hexadecimal strings and tokens lie inside such runs, so
their places are worked out only where a run holds one. The model, a number for each pair of key characters, is
read by the driver and stands in the plan as one array.

Spans count code points, end exclusive, as ``kind:start:end``. Null and empty texts have none. Ids may be
null or repeated; each row is scanned by itself. Empty tables train on nothing and give no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.sampling import fewest

SAMPLE = 2000
LEAST_TOKEN = 12
LEAST_RATIO = 1.0  # nats per transition
LEAST_EVIDENCE = 19.0  # nats in all: what 20 characters have at the least ratio, so shorter ones need more of it each

# fixed values: the kinds, their patterns and least lengths
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# a run of the characters of keys, long enough: a search meets its first character first, so matches are whole runs
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
LOW, CODES = ord("+"), ord("z") - ord("+") + 1  # of key characters: a transition's place is 80 times the first code and the second

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, long_enough: Column | None = None) -> Column:
    """Spans of all matches; starts are summed over what lies between the matches.

    ``long_enough`` maps the matches to an array of booleans.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(found, F.length)
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    steps = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"), lengths.alias("length"), (long_enough if long_enough is not None else F.transform(found, lambda _: F.lit(True))).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["length"]).alias("end"))
        return F.struct((start + x["length"]).alias("at"), F.when(x["ok"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(SPAN)
    return F.when(F.size(found) > 0, F.aggregate(steps, state, step, lambda acc: acc["spans"])).otherwise(none)


def base_spans(text: Column, runs: Column) -> Column:
    """The fixed patterns' spans in order of start, then kind; ``runs`` are the text's matches of ``RUN``."""
    none = F.array().cast(SPAN)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = _spans(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= LEAST["assign"]))
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), assign).otherwise(none)
    # shorter runs fail, and no longer one can begin inside a run: the least length may stand in the pattern
    access = _spans(text, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1)
    access = F.when(F.contains(text, F.lit("AKIA")), access).otherwise(none)
    hexes = _spans(text, rf"[0-9a-f]{{{LEAST['hex']},}}", 2)
    hexes = F.when(F.exists(runs, lambda r: (F.length(r) >= LEAST["hex"]) & r.rlike(rf"[0-9a-f]{{{LEAST['hex']}}}")), hexes).otherwise(none)
    found = F.concat(assign, access, hexes)
    return F.when(F.size(found) > 1, F.array_sort(found)).otherwise(found)


def _text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def samples(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> DataFrame:
    """(label, sample) from at most ``most`` documents: 1 for random strings, 0 for ordinary identifiers."""
    few = fewest(docs.select(F.col(text).cast("string").alias("_text")).where(F.length("_text") > 0), most, "_text")
    words = few.select(F.regexp_extract_all("_text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    # whole sample texts, in runs of three words
    runs = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0)), F.lit(3)), lambda i: F.slice("w", i + 1, 3))).alias("w")).where(F.size("w") == 3)
    pick = F.pmod(F.xxhash64("w"), F.lit(4))
    joined = (
        F.when(pick == 0, F.lower(F.array_join("w", "_")))
        .when(pick == 1, F.upper(F.array_join("w", "_")))
        .when(pick == 2, F.concat(F.element_at("w", 1), F.initcap(F.element_at("w", 2)), F.initcap(F.element_at("w", 3))))
        .otherwise(F.concat(F.array_join("w", "-"), F.lit("-"), (F.pmod(F.xxhash64("w", F.lit(1)), F.lit(1000))).cast("string")))
    )
    bytes_ = F.unhex(F.sha2(F.array_join("w", " "), 256))
    drawn = (
        F.when(pick == 0, F.rtrim(F.base64(bytes_)))
        .when(pick == 1, F.regexp_replace(F.base64(bytes_), "[+/=]", ""))
        .when(pick == 2, F.sha2(F.array_join("w", " "), 256))
        .otherwise(F.upper(F.regexp_replace(F.base64(bytes_), "[+/=]", "")))
    )
    return runs.select(F.explode(F.array(F.struct(F.lit(0).alias("label"), joined.alias("sample")), F.struct(F.lit(1).alias("label"), drawn.alias("sample")))).alias("s")).select("s.*")


def _pairs(token: Column) -> Column:
    """The transitions of a token."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(2)))


def markov(labelled: DataFrame) -> DataFrame:
    """(pair, ratio): log-likelihood ratio of each transition, at most one row per pair of key characters.

    Transition probabilities are smoothed by one half of a count over the 68 characters of keys.
    """
    pairs = labelled.where(F.length("sample") > 1).select("label", F.explode(_pairs(F.col("sample"))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum(F.lit(1) - F.col("label")).alias("plain"), F.sum("label").alias("random"))
    all_ = Window.partitionBy(F.substring("pair", 1, 1))
    p = lambda n: (F.col(n) + 0.5) / (F.sum(n).over(all_) + 34.0)
    return counts.select("pair", F.log(p("random") / p("plain")).alias("ratio"))


def _laid_out(model: DataFrame) -> Column:
    """The ratios by place, 0 where there is none: one array, a constant of the plan."""
    out = np.zeros(CODES * CODES)
    for pair, ratio in model.collect():
        out[(ord(pair[0]) - LOW) * CODES + ord(pair[1]) - LOW] = ratio
    return F.from_json(F.lit(json.dumps(out.tolist())), "array<double>")


def _total(token: Column, model: Column) -> Column:
    """The sum of the ratios of a token's transitions, in order."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - LOW)
    steps = F.size(codes) - 1
    ratios = F.zip_with(F.slice(codes, 1, steps), F.slice(codes, 2, steps), lambda a, b: F.get(model, a * CODES + b))
    return F.aggregate(ratios, F.lit(0.0), lambda acc, r: acc + r)


def scan(docs: DataFrame, *keep: str | Column, text: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """The columns ``keep`` with n_assign, n_access, n_hex, base and all spans as structs in ``found``."""
    model = _laid_out(markov(samples(docs, text)))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def random(r: Column) -> Column:
        evidence = F.greatest(least * (F.length(r) - 1), F.lit(LEAST_EVIDENCE))
        return (_total(r, model) >= evidence) & r.rlike("[A-Za-z]")  # digits alone are numbers

    rows = docs.select(*keep, whole.alias("_text")).withColumn("_runs", F.regexp_extract_all("_text", F.lit(RUN), F.lit(0)))
    rows = rows.withColumn("_base", base_spans(F.col("_text"), F.col("_runs"))).withColumn("_random", F.transform("_runs", random))
    names = [c for c in rows.columns if c not in ("_text", "_base", "_runs", "_random")]

    def fresh(s: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))

    extra = F.filter(_spans(F.col("_text"), RUN, 3, F.col("_random")), fresh)
    every = F.when(F.exists("_random", lambda ok: ok), F.array_sort(F.concat("_base", extra))).otherwise(F.col("_base"))
    return rows.select(*names, "_text", "_base", every.alias("_all"))


def digest(docs: DataFrame, *keep: str | Column, text: str = "text") -> DataFrame:
    """Per row the columns ``keep``, the base counts, the digest of the base spans and all spans as text."""
    found = scan(docs, *keep, text=text)
    names = [c for c in found.columns if c not in ("_text", "_base", "_all")]
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        *names,
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_text(F.col("_base")), 256).alias("base_sha256"),
        _text(F.col("_all")).alias("spans"),
    )


def masked(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span of their text replaced; overlapping spans become one mask. Null texts stay null."""
    row = F.struct(*docs.columns).alias("_row")
    found = scan(docs, row, text=text)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        ahead = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), ahead.alias("out"))

    clean = F.aggregate("_all", state, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    new = F.when(F.col(f"_row.`{text}`").isNull() | (F.size("_all") == 0), F.col(f"_row.`{text}`")).otherwise(clean)
    return found.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

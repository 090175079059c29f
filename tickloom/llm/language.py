"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams, trained on at most ``SAMPLE`` labelled texts. A first
verdict from the text alone gives each row's languages their probabilities; summed by group over all rows
they are the languages of a host, of its domain and of everything. The host's prior is its own sum smoothed
by the domain's, which is smoothed by the global one. The declared markup language and the address suffix
have likelihoods from the same sums. The posterior multiplies the host's prior, both likelihoods and the
text's.

Rows have ``id`` columns of any kind, address (null: none), declared (null: none) and text (null: empty;
no evidence, all languages equally likely). Equal rows get equal verdicts. Without labelled texts there
are no languages, and the verdict is null. A host of a third of all rows meets one row of priors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm import words as W
from tickloom.llm.sampling import fewest
from tickloom.session import checkpoint

SAMPLE = 2000
BUCKETS = 1 << 15
TRIGRAMS = 300.0  # the most that a text's trigrams count as: they are not independent
KAPPA = 20.0  # rows that a parent's distribution counts as


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, end of each text) of lower-cased texts with their digits dropped."""
    raws = [np.frombuffer(f" {t.lower()} ".encode(), np.uint8) for t in texts]
    ends = np.cumsum([0, *map(len, raws)])
    raw = np.concatenate(raws) if raws else np.zeros(0, np.uint8)
    codes = raw.astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.int32), np.minimum(ends, 0)
    tri = codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]
    letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
    good = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2
    for end in ends[1:-1]:  # no trigram reaches from one text into the next
        good[max(end - 2, 0) : end] = False
    total = np.concatenate([[0], np.cumsum(good)])
    return ((tri * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)[good], total[np.minimum(ends, len(good))]


class Model:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each language, tempered for long texts."""
        buckets, ends = _buckets(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate([[0.0], np.cumsum(self.table[:, k][buckets], dtype=np.float64)])
            out[:, k] = total[ends[1:]] - total[ends[:-1]]
        n = np.diff(ends)
        return out * (np.minimum(n, TRIGRAMS) / np.maximum(n, 1))[:, None]


def train(labelled: DataFrame, label: str = "lang", text: str = "text", most: int = SAMPLE) -> Model:
    """From at most ``most`` labelled texts, those of smallest hash; the counts are summed by Spark."""
    few = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("_text")).where("label IS NOT NULL AND length(_text) > 0")
    few = fewest(few, most, "label", "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for cut in W.cuts(batches, "_text"):
            for label, text in zip(cut.column("label").to_pylist(), cut.column("_text").to_pylist()):
                sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                sums[label] += np.bincount(_buckets([text])[0], minlength=BUCKETS)
        for label, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["label", "bucket", "n"])

    counts = few.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    table = np.full((BUCKETS, len(languages)), 0.5)
    for k, name in enumerate(languages):
        own = counts[counts["label"] == name]
        table[own["bucket"], k] += own["n"]
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table)


def text_scores(rows: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` with the log-likelihoods ``scores``."""
    narrow = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f for f in narrow.schema.fields if f.name != "_text"]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in W.cuts(batches, "_text", 2 << 20):
            found = shared.value.scores([t or "" for t in cut.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pa.array(list(found), pa.list_(pa.float64()))], [*cut.schema.names[:-1], "scores"])

    return narrow.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["scores array<double>"]))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    lifted = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(lifted, F.lit(0.0), lambda a, b: a + b)
    return F.transform(lifted, lambda s: s / total)


def _summed(n: int) -> list[Column]:
    return [F.sum(F.element_at("p", k + 1)).alias(f"_p{k}") for k in range(n)]


def _array(n: int, prefix: str = "_p") -> Column:
    return F.array(*[F.col(f"{prefix}{k}") for k in range(n)])


def identify(rows: DataFrame, model: Model, *ids: str, address: str = "address", declared: str = "declared", text: str = "text") -> DataFrame:
    """The columns ``ids`` with lang, probability, text_lang, declared and host of each row."""
    n = len(model.languages)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(address), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1))
    domain, suffix = F.regexp_extract("_host", r"([^.]*\.[^.]*)$", 1), F.regexp_extract("_host", r"\.([^.]*)$", 1)
    code = F.lower(F.regexp_extract(F.coalesce(F.col(declared), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    narrow = rows.select(*ids, host.alias("_host"), code.alias("_code"), F.col(text).alias("_in"))
    scored = text_scores(narrow, model, *ids, "_host", "_code", text="_in")
    if not n:
        return scored.select(*ids, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.col("_code").alias("declared"), F.col("_host").alias("host"))
    scored = checkpoint(scored.withColumn("_domain", F.when(domain == "", F.col("_host")).otherwise(domain)).withColumn("_suffix", suffix).withColumn("p", _softmax(F.col("scores"))))
    hosts = checkpoint(scored.groupBy("_host", "_domain").agg(*_summed(n)))
    both = lambda key: scored.groupBy(key).agg(*_summed(n))
    everything = hosts.agg(*[F.sum(f"_p{k}").alias(f"_g{k}") for k in range(n)])  # one row
    domains = hosts.groupBy("_domain").agg(*[F.sum(f"_p{k}").alias(f"_d{k}") for k in range(n)])
    total = lambda prefix: sum((F.col(f"{prefix}{k}") for k in range(n)), F.lit(0.0))
    smooth = lambda own, above, k: (F.col(f"{own}{k}") + KAPPA * above(k)) / (total(own) + KAPPA)
    top = lambda k: (F.col(f"_g{k}") + 1.0 / n) / (total("_g") + 1.0)
    priors = checkpoint(
        hosts.join(domains, "_domain").join(F.broadcast(everything)).select("_host", F.array(*[F.log(smooth("_p", lambda j: smooth("_d", top, j), k)) for k in range(n)]).alias("_prior"))
    )

    def likelihood(key: str, name: str) -> DataFrame:
        """log P(key | language), smoothed by the key's share of all rows."""
        own = both(key).join(F.broadcast(everything))
        share = (total("_p") + 0.5) / (total("_g") + 1.0)
        return checkpoint(own.select(key, F.array(*[F.log((F.col(f"_p{k}") + KAPPA * share) / (F.col(f"_g{k}") + KAPPA)) for k in range(n)]).alias(name)))

    fused = scored.join(priors, "_host").join(likelihood("_code", "_declared"), "_code").join(likelihood("_suffix", "_address"), "_suffix")
    none = F.array(*[F.lit(0.0)] * n)
    said = F.when(F.col("_code") != "", F.col("_declared")).otherwise(none)
    placed = F.when(F.col("_suffix") != "", F.col("_address")).otherwise(none)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    posterior = fused.withColumn("_post", _softmax(add(add("scores", "_prior"), add(said, placed))))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return posterior.select(*ids, best(F.col("_post")).alias("lang"), F.array_max("_post").alias("probability"), best(F.col("scores")).alias("text_lang"), F.col("_code").alias("declared"), F.col("_host").alias("host"))

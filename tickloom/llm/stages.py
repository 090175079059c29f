"""The pipeline's stages: each applies one operator to all documents and keeps their columns.

Columns may have any name: a stage's own ones stand beside one struct of the row. Every stage takes an empty table (it stays
empty), null texts, languages, sources and ids, empty and very long texts, and repeated rows, as its docstring says.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import jaccard, leaks, mixing as mix, secrets, tokens, words as W
from tickloom.llm.filters import key_filter, passes
from tickloom.session import checkpoint

CUT = 1 << 20  # bytes of text measured at a time
REMEMBERED = 100_000  # words whose tokens a worker keeps


def fresh_folder(shared: str) -> str:
    return f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def _rows(docs: DataFrame, *more) -> DataFrame:
    """Each row as one struct."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *more)


def _let_go() -> None:
    """Workers outlive a task and serve later stages: give the vocabularies' memory back."""
    tokens._Vocabularies.held.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the bands of their language; the others go.

    Null, empty and short texts fail the base rules. Repeated rows stay repeated. A null or unknown language means the bands
    of the script.
    """
    rows, rules = _rows(docs), tokens.Rules()
    measured = ", ".join([f"_row {rows.schema['_row'].dataType.simpleString()}", tokens.METRICS, *(f"{c} double" for c in tokens.PROSE)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field("text").cast(pa.string())], ["_row", "_text"])
                for cut in W.cuts([whole], "_text", CUT):
                    found = tokens.measures(cut.column(1), rules)
                    held = tokens._Vocabularies.of(rules)
                    if len(held.known) > REMEMBERED:
                        held._forget()
                    yield pa.RecordBatch.from_arrays([cut.column(0), *map(pa.array, found.values())], ["_row", *found])
        finally:
            _let_go()

    found = rows.mapInArrow(run, measured)
    return found.where(~tokens.base_failed() & tokens.within_bands(F.col("_row.lang"), rules)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the smallest id, then the first of equal rows.

    Texts without words are no group and all stay. A null id comes after all others.
    """
    # one row per content: a group keeps its smallest (id, key)
    keyed = _rows(docs, F.xxhash64(*docs.columns).alias("_key"))
    found = jaccard.join(keyed.select("_key", "_row.doc_id", "_row.text"), "_key", "doc_id", doc_id="_key", shingle=5, percent=80)
    rows = found.groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.first("component_id").alias("component_id"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    group = F.when(F.col("n") == 0, F.concat(F.lit("="), F.col("_key").cast("string"))).otherwise(F.col("component_id").cast("string"))
    rows = checkpoint(rows.withColumn("group", group))
    first = rows.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "_key")).alias("s")).select(F.col("s._key").alias("_key"), F.lit(True).alias("_stays"))
    # what goes, and what stays once of several equal rows with words; all other rows pass without a join
    several = (F.col("rows") > 1) & (F.col("n") > 0)
    touched = checkpoint(rows.join(first, "_key", "left").where(F.col("_stays").isNull() | several).select("_key", F.coalesce("_stays", F.lit(False)).alias("_stays")))
    held = spark.sparkContext.broadcast(key_filter(touched, "_key"))

    def sift(wanted: bool):
        def run(batches):
            for batch in batches:
                hit = passes(held.value, batch.column(1).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit if wanted else ~hit, pa.bool_()))

        return run

    some = keyed.mapInArrow(sift(True), keyed.schema).join(touched, "_key", "left")
    once = some.where("_stays").dropDuplicates(["_key"])
    return keyed.mapInArrow(sift(False), keyed.schema).select("_row").union(some.where("_stays IS NULL").union(once).select("_row")).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; equal rows stay or go together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _rows(docs, F.xxhash64(*docs.columns).alias("_key"))
    found = checkpoint(leaks.leaks(keyed.select("_key", "_row.text"), items, "_key").select("_key").distinct())
    return keyed.join(found, "_key", "left_anti").select("_row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars counted again where the text changed. Null texts stay null."""
    size = F.length("text")
    # what n_chars is off from the length of the text, before its secrets are masked
    new = secrets.masked(docs.withColumn("n_chars", F.struct(F.col("n_chars").alias("n"), size.alias("size"))))
    counted = F.when(size != F.col("n_chars.size"), size).otherwise(F.col("n_chars.n")).cast(docs.schema["n_chars"].dataType)
    return new.withColumn("n_chars", counted).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: per document its size, the target of its source, the words taken and the output shards.

    Null and empty texts have size 0 and take nothing. A null source is a source of its own, the last one. Equal rows are rows
    of their own."""
    return mix.mix_plan(docs, "doc_id", "source")

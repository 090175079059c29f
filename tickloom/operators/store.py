"""Keyed upsert, retention, schema shaping, table scans and sinks."""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom import config
from tickloom.functions.numeric import to_double
from tickloom.operators.bars import dedupe_last, latest_n

# Fixed type names of the feature specification.
SPEC_TYPES = {
    "float64": "double",
    "float32": "double",
    "double": "double",
    "float": "double",
    "int64": "bigint",
    "int32": "int",
    "int": "int",
    "boolean": "boolean",
    "bool": "boolean",
    "string": "string",
    "str": "string",
}


# ------------------------------------------------------------------ bar table


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """One table for all timeframes, partitioned by timeframe and month, sorted for pruning."""
    monthly = bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
    (
        monthly.repartition("tf", "month", F.pmod(F.xxhash64("token"), F.lit(8)))
        .sortWithinPartitions("token", "ts")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tf", "month")
        .parquet(path)
    )


def scan_bars(bars: DataFrame, tokens: Sequence[str], timeframes: Sequence[str], start: str, end: str) -> DataFrame:
    """Inclusive range scan; a stored table also prunes its month partitions."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    found = bars.filter(F.col("tf").isin(list(timeframes)) & F.col("token").isin(list(tokens)) & F.col("ts").between(lo, hi))
    if "month" in bars.columns:
        found = found.filter(F.col("month").between(start[:7], end[:7])).drop("month")
    return found


def read_labelled(spark: SparkSession, path: str, horizon: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if horizon is not None:
        df = df.filter(F.col("horizon") == horizon)
    return df.filter(F.col("ts").isNotNull())


def write_labelled(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("horizon").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------------ change-only upsert


def upsert(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Target after the upsert, with ``action`` insert, update or unchanged.

    Unknown update columns are ignored; a row counts as updated only if a value differs
    (NULL-safe). Of duplicate keys in a batch the last by ``order`` wins; without an order
    duplicate keys are an error, raised when the result is computed.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("upsert needs key columns")
    missing = [k for k in keys if k not in target.columns or k not in updates.columns]
    if missing:
        raise ValueError(f"key columns missing: {missing}")
    known = [c for c in updates.columns if c in target.columns and c not in keys]
    if order:
        batch = dedupe_last(updates, keys, order).withColumn("_in_batch", F.lit(True))
    else:
        twice = F.raise_error(F.lit(f"duplicate keys {keys} in the batch: give an order"))
        batch = updates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in known])
        batch = batch.withColumn("_in_batch", F.when(F.col("_rows") > 1, twice.cast("boolean")).otherwise(F.lit(True)))
    batch = batch.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in known], "_in_batch")
    joined = target.withColumn("_stored", F.lit(True)).join(batch, keys, "full_outer")
    same = F.lit(True)
    for c in known:
        same = same & F.col(c).eqNullSafe(F.col(f"_u_{c}"))
    action = F.when(F.col("_stored").isNull(), "insert").when(F.col("_in_batch").isNotNull() & ~same, "update").otherwise("unchanged")
    values = [
        (F.when(F.col("_in_batch").isNotNull(), F.col(f"_u_{c}")).otherwise(F.col(c)) if c in known else F.col(c)).alias(c)
        for c in target.columns
        if c not in keys
    ]
    return joined.select(*keys, *values, action.alias("action"))


def touched_partitions(stored: DataFrame, updates: DataFrame, partition: str, most: int = 10_000) -> DataFrame:
    """The stored rows of the batch's partitions, as a filter the scan prunes by. A batch
    over more than ``most`` partitions is an error, so the list stays bounded."""
    found = [r[0] for r in updates.select(partition).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"the batch touches more than {most} partitions of {partition}")
    inside = F.col(partition).isin([v for v in found if v is not None])
    return stored.filter(inside | F.col(partition).isNull() if None in found else inside)


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], partition: str, order: Sequence[str] | None = None) -> None:
    """Merge a batch into a stored table: only the partitions the batch touches are read and replaced."""
    stored = spark.read.parquet(path)
    current = touched_partitions(stored, updates, partition)
    merged = upsert(current, updates, keys, order).drop("action").select(*stored.columns)
    replace_partitions(spark, path, merged, partition)


def replace_partitions(spark: SparkSession, path: str, rows: DataFrame, partition: str) -> None:
    """Put ``rows`` in the place of the partitions they fill. They may come from the table itself: they are written beside
    it first, because a job cannot overwrite the files it reads; every call has a staging folder of its own and removes it."""
    staging = f"{path.rstrip('/')}_staging-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").partitionBy(partition).parquet(staging)
    (
        spark.read.schema(rows.schema)
        .parquet(staging)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    place = spark._jvm.org.apache.hadoop.fs.Path(staging)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# ------------------------------------------------------------------ retention


def rolling_retention(
    stored: DataFrame | None,
    incoming: DataFrame,
    keep: int,
    keys: Sequence[str],
    order: Sequence[str],
    mode: str = "rolling_append",
    dedupe_on: Sequence[str] = (),
) -> DataFrame:
    """Overwrite, or append and keep the last ``keep`` rows of each series by arrival.

    Unknown modes overwrite. ``keep`` of 0 or less leaves nothing.
    """
    appending = mode in ("rolling_append", "append", "rolling")
    if not appending or stored is None:
        rows = incoming
    else:
        rows = stored.unionByName(incoming, allowMissingColumns=True)
    if not appending:
        return rows
    if keep <= 0:
        return rows.limit(0)
    if dedupe_on:
        rows = dedupe_last(rows, dedupe_on, order)
    return latest_n(rows, keep, keys, order)


def prune_window(df: DataFrame, now: Column, days: int = config.LOOKBACK_DAYS, ts: str = "ts") -> DataFrame:
    """Keep rows of the last ``days`` days before ``now``."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


# ------------------------------------------------------------------ schema shaping


def widen(df: DataFrame, features: Sequence[str] = tuple(config.FEATURES), flag: str | None = config.EVENT_FLAG) -> DataFrame:
    """Add missing feature columns: NULL doubles, and a false event flag."""
    added = {c: F.lit(None).cast("double") for c in features if c not in df.columns}
    if flag is not None:
        added[flag] = F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False)
    return df.withColumns(added)


def union_common(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames on the columns they all have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    stacked = frames[0].select(common)
    for f in frames[1:]:
        stacked = stacked.unionByName(f.select(common))
    return stacked


def conform(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Cast to the named types (in any case, blanks around them; unknown or no type: double), add missing columns, drop unknown."""
    kind = lambda name: SPEC_TYPES.get((name or "").strip().lower(), "double")
    return df.select(
        *[
            (F.col(c).try_cast(kind(t)) if c in df.columns else F.lit(None).cast(kind(t))).alias(c)
            for c, t in spec.items()
        ]
    )


def horizon_subset(df: DataFrame, wanted: Sequence[str], always: Sequence[str] = ("token", "ts")) -> DataFrame:
    """The wanted columns that exist; all columns if none does."""
    found = [c for c in wanted if c in df.columns]
    return df.select(*[c for c in always if c in df.columns], *found) if found else df


def categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categories as text, missing ones as the empty category."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def sanitize(
    df: DataFrame, features: Sequence[str] = tuple(config.FEATURES), flag: str = config.EVENT_FLAG, how: str = "any"
) -> DataFrame:
    """Whitelist in fixed order, coerce to finite doubles, false for a missing flag, and drop
    rows with any (``how="any"``) or only (``how="all"``) missing numbers."""
    numbers = [c for c in features if c in df.columns]
    event = F.coalesce(F.col(flag).try_cast("boolean"), F.lit(False)) if flag in df.columns else F.lit(False)
    keys = [c for c in ("horizon", "ts", "token") if c in df.columns]
    clean = df.select(*[F.col(c).cast("string") if c == "token" else F.col(c) for c in keys], *[to_double(c).alias(c) for c in numbers], event.alias(flag))
    return clean.dropna(how=how, subset=numbers) if numbers else clean


def sanitize_report(df: DataFrame, features: Sequence[str] = tuple(config.FEATURES), by: Sequence[str] = ("token",)) -> DataFrame:
    """How many rows the sanitising would keep and drop, in one aggregation."""
    numbers = [to_double(c) for c in features if c in df.columns]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | c.isNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("dropped")
    )


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column, non_null) for every column, from one aggregation."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in df.columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def without_empty_columns(df: DataFrame, where: str | None = None) -> DataFrame:
    """Drop columns that hold no value at all. The one small count row decides the plan."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    kept = df.select(*[c for c in df.columns if counts[c] > 0])
    return kept.filter(F.expr(where)) if where else kept


def dataset_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: rows, columns and column names."""
    profile = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(", ".join(df.columns)).alias("names")
        )
        profile = row if profile is None else profile.unionByName(row)
    return profile


def dataset_samples(frames: dict[str, DataFrame], n: int = 3) -> DataFrame:
    """The first rows of each dataset as JSON text (a preview: the limit is the feature)."""
    samples = None
    for name, df in frames.items():
        rows = df.limit(n).select(F.lit(name).alias("dataset"), F.to_json(F.struct(*df.columns)).alias("row"))
        samples = rows if samples is None else samples.unionByName(rows)
    return samples

"""Distributions of features as mergeable counts, kept between runs, and their drift as a population stability index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CELLS = 16  # cells for each factor of e, so a cell is about 6 % wide
MOST_PARTS = 20


def cell(value: Column, cells: int = CELLS) -> Column:
    """Number of the cell a value lies in: even steps of asinh, so cells are relative for large values and even around 0.
    Values that are missing or not finite have none."""
    size = F.abs(value)
    finite = size < F.lit(float("inf"))
    return F.when(finite, F.floor(F.signum(value) * F.log(size + F.sqrt(size * size + 1.0)) * F.lit(cells)).cast("long"))


def profile(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), cells: int = CELLS) -> DataFrame:
    """(by..., feature, cell, n): how many rows have each feature in each cell. NULL is the cell of missing values.

    A feature has at most some twenty thousand cells however many rows there are, and tasks add their rows up first.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), cell(F.col(f).cast("double"), cells).alias("cell")) for f in features])
    return df.select(*by, F.inline(pairs)).groupBy(*by, "feature", "cell").agg(F.count(F.lit(1)).alias("n"))


def merge_profiles(profiles: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The profile of all rows of several."""
    stacked = profiles[0]
    for p in profiles[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy(*by, "feature", "cell").agg(F.sum("n").alias("n"))


def store_profile(made: DataFrame, path: str, run: str) -> None:
    """Keep a run's profile; a run that is repeated replaces its own."""
    made.write.mode("overwrite").parquet(f"{path}/run={run}")


def stored_profile(spark: SparkSession, path: str, runs: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The merged profile of the stored runs, or of those named."""
    rows = spark.read.option("basePath", path).parquet(*([f"{path}/run={r}" for r in runs] if runs is not None else [path]))
    return merge_profiles([rows], by)


def parts_of(reference: DataFrame, by: Sequence[str] = (), most: int = MOST_PARTS) -> DataFrame:
    """(by..., feature, cell, part, parts): the reference's cells in parts of about equal weight.

    There are as many parts as the root of the number of cells, between 2 and ``most``; cells are never cut.
    """
    keys = [*by, "feature"]
    rows = reference.filter(F.col("cell").isNotNull())
    everything = Window.partitionBy(*keys)
    before = everything.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.least(F.greatest(F.floor(F.sqrt(F.count(F.lit(1)).over(everything))), F.lit(2)), F.lit(most)).cast("int")
    counted = rows.select(*keys, "cell", parts.alias("parts"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(everything).alias("_all"))
    return counted.select(*keys, "cell", F.expr("cast(_before * parts div _all AS int)").alias("part"), "parts")


def drift(reference: DataFrame, current: DataFrame, by: Sequence[str] = (), most: int = MOST_PARTS) -> DataFrame:
    """(by..., feature, parts, n_reference, n_current, missing_reference, missing_current, psi) of two profiles.

    The index adds up (q - p) ln(q / p) over the parts of the reference, missing values being one more part; each count is
    taken half a row larger, so that empty parts are finite. Values between or beyond the reference's cells belong to the part of the
    nearest cell below, those below all to the first. Features that only one side has get the other's counts as 0.
    """
    keys = [*by, "feature"]
    named = parts_of(reference, by, most)
    sides = reference.select(*keys, "cell", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        current.select(*keys, "cell", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    )
    rows = sides.groupBy(*keys, "cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).join(named, [*keys, "cell"], "left")
    below = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("part", F.when(F.col("cell").isNull(), -1).otherwise(F.coalesce(F.last("part", True).over(below), F.lit(0))))
    per = placed.groupBy(*keys, "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("parts").alias("parts"))
    everything = Window.partitionBy(*keys)
    # parts that hold a cell of either side, the missing ones included
    k, total = F.count(F.lit(1)).over(everything), lambda c: F.sum(c).over(everything)
    share = lambda c: (F.col(c) + 0.5) / (total(c) + 0.5 * k)
    shares = per.withColumns({"p": share("a"), "q": share("b")})
    missing = lambda c: F.coalesce(F.sum(F.when(F.col("part") == -1, F.col(c))), F.lit(0)).cast("long")
    return shares.groupBy(*keys).agg(
        F.coalesce(F.max("parts"), F.lit(0)).alias("parts"),
        F.sum("a").cast("long").alias("n_reference"),
        F.sum("b").cast("long").alias("n_current"),
        missing("a").alias("missing_reference"),
        missing("b").alias("missing_current"),
        F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"),
    )

"""Feature drift and data freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom import config
from tickloom.functions.numeric import nan_to_null


def _long(df: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), nan_to_null(F.col(c).cast("double")).alias("v")) for c in features])
    return df.select(F.explode(pairs).alias("p")).select("p.*", F.lit(side).alias("side")).filter(F.col("v").isNotNull())


def drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    threshold: float = 0.1,
    parts: int = 64,
) -> DataFrame:
    """Per feature: exact Kolmogorov-Smirnov statistic, Wasserstein distance divided by the
    reference deviation (at least 0.001), and ``drifted`` if that reaches the threshold.

    Counts per distinct value are cut into ``parts`` value ranges per feature, so the
    cumulative counts run over (feature, range) and never over a whole feature.
    """
    skip = {"ts", "token", "timestamp"}
    features = list(features or [c for c in reference.columns if c in current.columns and c not in skip])
    long = _long(reference, features, "ref").unionByName(_long(current, features, "cur"))
    is_ref, is_cur = (F.col("side") == "ref").cast("long"), (F.col("side") == "cur").cast("long")
    values = long.groupBy("feature", "v").agg(F.sum(is_ref).alias("nr"), F.sum(is_cur).alias("nc"))
    # one row per feature: bounded by the width of the table
    cuts = long.groupBy("feature").agg(
        F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000).alias("cuts"),
        F.greatest(F.coalesce(F.stddev_pop(F.when(F.col("side") == "ref", F.col("v"))), F.lit(0.0)), F.lit(0.001)).alias("scale"),
    )
    placed = values.join(F.broadcast(cuts.select("feature", "cuts")), "feature").select(
        "feature", "v", "nr", "nc", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("part")
    )
    sums = placed.groupBy("feature", "part").agg(F.sum("nr").alias("_r"), F.sum("nc").alias("_c"), F.min("v").alias("_lo"))
    along = Window.partitionBy("feature").orderBy("part")
    before, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    # features x parts rows
    bases = sums.select(
        "feature",
        "part",
        F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
        F.sum("_r").over(whole).alias("_rn"),
        F.sum("_c").over(whole).alias("_cn"),
        F.lead("_lo").over(along).alias("_next_lo"),
    )
    inside = Window.partitionBy("feature", "part").orderBy("v")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(
        (F.col("_r0") + F.sum("nr").over(running)) / F.col("_rn") - (F.col("_c0") + F.sum("nc").over(running)) / F.col("_cn")
    )
    curve = placed.join(F.broadcast(bases), ["feature", "part"]).select(
        "feature", gap.alias("gap"), (F.coalesce(F.lead("v").over(inside), F.col("_next_lo")) - F.col("v")).alias("step")
    )
    stats = curve.groupBy("feature").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce(F.col("step"), F.lit(0.0))).alias("distance"))
    return stats.join(F.broadcast(cuts.select("feature", "scale")), "feature").select(
        "feature",
        "ks",
        (F.col("distance") / F.col("scale")).alias("wasserstein"),
        (F.col("distance") / F.col("scale") >= threshold).alias("drifted"),
    )


def drift_level(per_feature: DataFrame, moderate: float = config.DRIFT_MODERATE, severe: float = config.DRIFT_SEVERE) -> DataFrame:
    """Share of drifted features and the action level."""
    share = per_feature.agg(
        F.count(F.lit(1)).alias("features"), F.sum(F.col("drifted").cast("long")).alias("drifted"), F.avg(F.col("drifted").cast("double")).alias("share")
    )
    return share.withColumn("level", F.when(F.col("share") >= severe, "severe").when(F.col("share") >= moderate, "moderate").otherwise("none"))


def freshness(datasets: DataFrame, now: Column, limit_seconds: int = config.FRESHNESS_SECONDS, by: str = "dataset") -> DataFrame:
    """Age of the newest row of each dataset; a dataset without a time has no data."""
    newest = datasets.groupBy(by).agg(F.max("ts").alias("newest_ts"))
    age = (F.unix_micros(now) - F.unix_micros("newest_ts")) / F.lit(1e6)
    return newest.withColumn("age_seconds", age).withColumn(
        "status", F.when(F.col("newest_ts").isNull(), "no data").when(F.col("age_seconds") > limit_seconds, "stale").otherwise("fresh")
    )

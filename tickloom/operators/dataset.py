"""Chronological split, sample weights and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom import config


def cut_points(
    df: DataFrame, ts: str = "ts", tie: Sequence[str] = ("token",), train_and_val: float = config.SPLIT_TRAIN_AND_VAL, val: float = config.SPLIT_VAL, whole_timestamps: bool = False
) -> Column:
    """One scalar: ``first`` and ``second``, the (ts, tie...) behind the train rows and behind train and val, NULL where no row lies
    behind, and ``newest``, the train rows' last ts (NULL if there is no ``first``).

    Ranks come from row counts per timestamp, cumulated over days and then inside each day. Both cuts are found in that one
    table, and the rows of their two timestamps are ranked in one further pass.
    """
    share = max(0.0, train_and_val - val)
    counts = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", F.floor(F.unix_seconds(ts) / 86400))
    days = counts.groupBy("_day").agg(F.sum("_n").alias("_dn"))
    by_day = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    # one row per calendar day: the only window over the whole table's time axis
    days = days.select(
        "_day",
        F.coalesce(F.sum("_dn").over(by_day), F.lit(0)).alias("_base"),
        F.sum("_dn").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    in_day = Window.partitionBy("_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_n").over(in_day), F.lit(0))
    k1 = F.floor(F.col("_total") * F.lit(share))
    per_ts = counts.join(days, "_day").select(ts, "_n", before.alias("_before"), k1.alias("_k1"), (k1 + F.floor(F.col("_total") * F.lit(val))).alias("_k2"))

    def spot(k: str) -> Column:
        inside = (F.col("_before") <= F.col(k)) & (F.col(k) < F.col("_before") + F.col("_n"))
        return F.max(F.when(inside, F.struct(F.col(ts).alias("ts"), (F.col(k) - F.col("_before") + 1).alias("want"))))

    trained = F.col("_before") + F.col("_n") <= F.col("_k1") if whole_timestamps else F.col("_before") < F.col("_k1")
    spots = per_ts.agg(spot("_k1").alias("_a"), spot("_k2").alias("_b"), F.max(F.when(trained, F.col(ts))).alias("_newest"))
    if whole_timestamps:
        here = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.ts").alias(ts)))
        return spots.select(F.struct(here("_a").alias("first"), here("_b").alias("second"), F.col("_newest").alias("newest"))).scalar()
    # two timestamps at most; the joined table is one row
    at = df.select(F.col(ts).alias("_ts"), F.struct(ts, *tie).alias("_row")).join(F.broadcast(spots), (F.col("_ts") == F.col("_a.ts")) | (F.col("_ts") == F.col("_b.ts")))
    ranked = at.withColumn("_rank", F.row_number().over(Window.partitionBy("_ts").orderBy("_row")))
    found = lambda c: F.max(F.when((F.col("_ts") == F.col(f"{c}.ts")) & (F.col("_rank") == F.col(f"{c}.want")), F.col("_row")))
    return ranked.agg(found("_a").alias("first"), found("_b").alias("second"), F.max("_newest").alias("newest")).select(F.struct("first", "second", "newest")).scalar()


def _part(cuts: str, ts: str, tie: Sequence[str], whole_timestamps: bool) -> Column:
    here = F.struct(ts) if whole_timestamps else F.struct(ts, *tie)
    first, second = F.col(f"{cuts}.first"), F.col(f"{cuts}.second")
    return F.when(first.isNull() | (here < first), "train").when(second.isNull() | (here < second), "val").otherwise("test")


def chrono_split(
    df: DataFrame,
    ts: str = "ts",
    tie: Sequence[str] = ("token",),
    train_and_val: float = config.SPLIT_TRAIN_AND_VAL,
    val: float = config.SPLIT_VAL,
    whole_timestamps: bool = False,
) -> DataFrame:
    """Add ``split`` (train, val, test) by global (ts, tie) order; ``tie`` must tell the rows
    of one timestamp apart. The table itself is not shuffled: it is compared with the cut points."""
    cuts = cut_points(df, ts, tie, train_and_val, val, whole_timestamps)
    return df.withColumn("_cuts", cuts).withColumn("split", _part("_cuts", ts, tie, whole_timestamps)).drop("_cuts")


def decay_weight(ts: str | Column, newest: Column, half_life: float = config.DECAY_HALF_LIFE_MONTHS, floor: float = config.DECAY_FLOOR) -> Column:
    """Weight in [floor, 1] that halves its decaying part every ``half_life`` months."""
    import math

    months = (F.unix_micros(newest) - F.unix_micros(ts)) / F.lit(1e6) / F.lit(86400.0) / F.lit(config.DAYS_PER_MONTH)
    return F.lit(floor) + F.lit(1.0 - floor) * F.exp(F.lit(-math.log(2.0) / half_life) * months)


def decay_weights(df: DataFrame, of: Column | None = None, ts: str = "ts") -> DataFrame:
    """Add ``weight`` relative to the newest row (of the rows where ``of`` holds; the others
    get NULL)."""
    chosen = df if of is None else df.filter(of)
    newest = chosen.agg(F.max(ts)).scalar()
    weight = decay_weight(ts, F.col("_newest"))
    return df.withColumn("_newest", newest).withColumn("weight", weight if of is None else F.when(of, weight)).drop("_newest")


def walk_forward_folds(df: DataFrame, train: int, val: int, step: int, unit: str = "month", ts: str = "ts") -> DataFrame:
    """Rolling (train, validation) windows from the first timestamp; the last one ends by
    the last timestamp. One row of bounds in, one row per fold out."""
    if unit not in ("month", "day"):
        raise ValueError(f"unknown unit {unit!r}")
    span = df.agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))

    def onward(t: Column, n: int) -> Column:
        return t + (F.make_dt_interval(days=F.lit(n)) if unit == "day" else F.make_ym_interval(months=F.lit(n)))

    days = F.datediff("t1", "t0")
    most = F.floor(days / (step if unit == "day" else step * 28)).cast("int")
    rolled = span.select("t0", "t1", F.explode(F.sequence(F.lit(0), F.greatest(most, F.lit(0)))).alias("fold"))
    # step by step: a start clipped to a short month stays clipped
    start = F.aggregate(F.sequence(F.lit(0), F.col("fold")), F.col("t0"), lambda t, i: F.when(i == 0, t).otherwise(onward(t, step)))
    folds = rolled.select("fold", "t1", start.alias("train_start"))
    folds = folds.withColumn("train_end", onward(F.col("train_start"), train))
    folds = folds.withColumn("val_start", F.col("train_end")).withColumn("val_end", onward(F.col("val_start"), val))
    return folds.filter((F.col("val_end") <= F.col("t1")) & (F.col("train_start") < F.col("t1"))).drop("t1")


def assign_folds(df: DataFrame, folds: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of every fold they belong to, with ``part`` train or val.

    Folds are configuration-sized (one row per step of calendar time), so they travel as one
    array to every task and each row explodes only into its own folds.
    """
    packed = folds.agg(F.collect_list(F.struct("fold", "train_start", "train_end", "val_start", "val_end"))).scalar()
    t = F.col(ts)
    mine = F.filter(F.col("_folds"), lambda f: (f["train_start"] <= t) & (t < f["val_end"]))
    return (
        df.withColumn("_folds", packed)
        .withColumn("_f", F.explode(mine))
        .withColumn("fold", F.col("_f")["fold"])
        .withColumn("part", F.when(t < F.col("_f")["train_end"], "train").otherwise("val"))
        .drop("_folds", "_f")
    )


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Everything but time, prices and targets."""
    return [c for c in columns if c not in {"ts", "open", "high", "low", "close"} and not c.startswith("target_")]


def prepared(df: DataFrame, target: str, folds: DataFrame | None = None, ts: str = "ts", tie: Sequence[str] = ("token",)) -> DataFrame:
    """Rows with a target, their split, their train weight and, with ``folds``, their folds. Split and weights take one set of
    cut points."""
    ready = df.filter(F.col(target).isNotNull())
    cut = ready.withColumn("_cuts", cut_points(ready, ts, tie)).withColumn("split", _part("_cuts", ts, tie, False))
    ready = cut.withColumn("weight", F.when(F.col("split") == "train", decay_weight(ts, F.col("_cuts.newest")))).drop("_cuts")
    return assign_folds(ready, folds, ts) if folds is not None else ready


def class_metrics(scored: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Log loss, accuracy and macro F1 of (y, pred, probas: map label -> probability)."""
    eps = 1e-15
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.coalesce(F.element_at("probas", F.col("y")), F.lit(0.0))))
    per = [F.avg(-F.log(p)).alias("log_loss"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy")]
    for i, label in enumerate(labels):
        is_y, is_p = F.col("y") == label, F.col("pred") == label
        per += [F.sum((is_y & is_p).cast("long")).alias(f"_tp{i}"), F.sum(is_y.cast("long") + is_p.cast("long")).alias(f"_yp{i}")]
    agg = scored.groupBy(*by).agg(*per)
    # classes that neither occur nor are predicted do not count
    f1 = [F.when(F.col(f"_yp{i}") > 0, F.lit(2.0) * F.col(f"_tp{i}") / F.col(f"_yp{i}")) for i in range(len(labels))]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0))
    used = sum((x.isNotNull().cast("int") for x in f1), F.lit(0))
    return agg.select(*by, "log_loss", "accuracy", F.try_divide(total, used).alias("macro_f1"))

"""Market-shaped views over the driver tables; each one is a plain DataFrame query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.bars import resample, ticks_to_bars
from tickloom.sources.tables import table

TIMEFRAMES = ("1h", "4h", "1d", "7d")
HORIZON_ROLES = {"15m": "1h", "1h": "4h", "4h": "1d", "1d": "7d"}
# Small windows: the 30 days of ticks hold only a few 7d bars.
WINDOWS = {
    "1h": {"15m": (14, 14, 10), "1h": (None, 14, 10), "4h": (None, 5, 5), "1d": (None, 2, 1)},
    "4h": {"15m": (14, 20, 14), "1h": (None, 14, 14), "4h": (None, 5, 4), "1d": (None, 2, 2)},
}
# The 8h horizon in the same style; queries over all three horizons have a SQL twin of their own.
ALL_WINDOWS = {**WINDOWS, "8h": {"15m": (14, 20, 20), "1h": (None, 14, 20), "4h": (None, 5, 5), "1d": (None, 2, 2)}}


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("token"),
        "ts",
        F.col("value").alias("price"),
        F.lit(1.0).alias("qty"),
        F.col("event_id").alias("tick_id"),
    )


def bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf), 3600)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of all timeframes (with ``tf``) in one aggregation over the hourly ones."""
    return resample(bars_1h(spark, sf), TIMEFRAMES)


def econ_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    return e.select("ts", F.when(F.col("event_id") % 2 == 0, "High ").otherwise("low").alias("impact"))


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """One trade per line of an order, known by the line's key columns."""
    lines = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    entry = F.col("l_extendedprice") / F.col("l_quantity")
    exit_ts = F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", *[F.col(c).cast("bigint").cast("string") for c in LINE_KEY]).alias("trade_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_no"),
        F.col("o_custkey").alias("account"),
        F.col("l_returnflag").alias("token"),
        F.when(F.col("l_linestatus") == "F", "long").otherwise("short").alias("direction"),
        entry.alias("entry_price"),
        F.col("l_quantity").alias("position_size"),
        (entry * (1 + F.col("l_tax") - F.col("l_discount"))).alias("exit_price"),
        (F.col("l_tax") * 10).alias("fees"),
        F.col("o_orderdate").alias("entry_ts"),
        exit_ts.alias("exit_ts"),
        F.col("l_orderkey").alias("signal_id"),
    )


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """A position opened by the first tick of every token and day."""
    day = F.to_date("ts")
    first = ticks(spark, sf).groupBy("token", day.alias("day")).agg(
        F.min_by("price", "tick_id").alias("entry_price"), F.min_by("ts", "tick_id").alias("entry_ts")
    )
    long = F.pmod(F.dayofmonth("day"), F.lit(2)) == 0
    return first.select(
        F.concat_ws("-", "token", F.col("day").cast("string")).alias("position_id"),
        "token",
        F.when(long, "long").otherwise("short").alias("direction"),
        "entry_price",
        "entry_ts",
        F.when(long, F.col("entry_price") * 0.25).otherwise(F.col("entry_price") * 4.0).alias("stop_loss"),
        F.when(long, F.col("entry_price") * 4.0).otherwise(F.col("entry_price") * 0.25).alias("take_profit"),
    )


LABEL_OF_PRIORITY = {
    "1-URGENT": "OPEN_LONG",
    "2-HIGH": "OPEN_SHORT",
    "3-MEDIUM": "EXIT_LONG",
    "4-NOT SPECIFIED": "EXIT_SHORT",
    "5-LOW": "HOLD",
}


def signals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    label = reduce(lambda acc, kv: acc.when(F.col("o_orderpriority") == kv[0], kv[1]), LABEL_OF_PRIORITY.items(), F)
    return o.select(
        F.col("o_orderkey").alias("signal_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("token"),
        label.alias("label"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("prob"),
        F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit("run-"), (F.col("o_custkey") % 4).cast("string"))).alias("run_id"),
        F.col("o_totalprice").alias("price"),
    )


MODEL_WEIGHTS = {"model_a": 1.0, "model_b": 2.0}


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Three models x five labels per signal; unnormalised integer scores over 100."""
    from tickloom.config import LABELS

    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("mi")) for i, m in enumerate(("model_a", "model_b", "model_c"))])).alias("m")
    labels = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(i).alias("li")) for i, n in enumerate(LABELS)])).alias("l")
    s = signals(spark, sf).select("signal_id", "ts", "token", "price", models).select("*", labels)
    score = F.pmod(F.col("signal_id") * 7 + F.col("m.mi") * 3 + F.col("l.li") * (F.col("signal_id") % 11 + 13), F.lit(97))
    return s.select(
        "signal_id",
        "token",
        "ts",
        F.col("m.model").alias("model"),
        F.col("l.label").alias("label"),
        (score / 100.0).alias("prob"),
        F.when(F.col("signal_id") % 10 > 0, F.col("price")).alias("entry_price"),
    )


def long_signals(spark: SparkSession, sf: str, model: str = "model_a") -> DataFrame:
    """Bars on which a model opens a long: model_a after a rise, model_b after a fall."""
    b = bars_1h(spark, sf)
    rise = F.col("close") > F.col("open")
    fall = F.col("close") < F.col("open")
    return b.filter(rise if model == "model_a" else fall).select("token", "ts")

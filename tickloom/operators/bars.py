"""Ticks to bars, bars to coarser bars, coverage and gaps."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.config import TIMEFRAMES
from tickloom.operators import series

OHLCV = ["open", "high", "low", "close", "volume"]


def bucket(ts: str | Column, seconds: int | Column, origin: int = 0) -> Column:
    """Start of the fixed, epoch-aligned bucket that holds ``ts``."""
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    second = F.unix_seconds(ts) - F.lit(origin)
    return F.timestamp_seconds(second - F.pmod(second, seconds) + F.lit(origin))


TICK_ORDER = "tick_order"


def tick_order(ts: str | Column = "ts", symbol: str | Column | None = None, sequence: str | Column | None = None, price: str | Column = "price", size: str | Column = "qty") -> Column:
    """One fixed-width key, DECIMAL(38,0), that orders ticks as they were traded: 19 digits of microseconds, then three
    of the symbol, then 19 of the sequence.

    Sequences are numbers of one symbol, so they only tell ticks of one symbol and instant apart. A tick without a
    sequence gets a number from its price and size: the order is the same in every run, and never NULL where the
    time isn't.
    """
    named = lambda c, none: F.lit(none) if c is None else F.col(c) if isinstance(c, str) else c
    rank = F.pmod(F.crc32(F.coalesce(named(symbol, None).cast("string"), F.lit(""))), F.lit(1000))
    stand_in = F.crc32(F.concat_ws("|", named(price, None).cast("string"), named(size, None).cast("string")))
    number = F.greatest(F.coalesce(named(sequence, None).cast("long"), stand_in), F.lit(0))
    digits = lambda c, n: c.cast(f"decimal({n},0)")
    micros = F.unix_micros(named(ts, None))
    return digits(digits(micros, 16) * F.lit(Decimal(10**22)) + (digits(rank, 3) * F.lit(Decimal(10**19)) + digits(number, 19)), 38)


def order_of(ticks: DataFrame, seq: Sequence[str] | None = None) -> Sequence[str]:
    """The columns that order ticks: those named, else the key of ``tick_order`` if there is one, else the arrival number."""
    return seq or ((TICK_ORDER,) if TICK_ORDER in ticks.columns else ("tick_id",))


def ohlcv_of_ticks(seq: Sequence[str] = ("tick_id",)) -> list[Column]:
    """Open and close follow the order of the ticks. One fixed-width column keeps the
    aggregation hash-based; several columns (a struct) make Spark sort before it."""
    # min_by skips rows without an order: they are the first ones, so that no open or close is lost
    order = F.coalesce(F.col(seq[0]), F.lit(-1)) if len(seq) == 1 else F.struct(*seq)
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
    ]


def ticks_to_bars(
    ticks: DataFrame, seconds: int = 60, keys: Sequence[str] = ("token",), seq: Sequence[str] | None = None
) -> DataFrame:
    """Ticks are pre-aggregated map-side, so a hot token ships one row per bucket and task."""
    return (
        ticks.groupBy(*keys, bucket("ts", seconds).alias("ts"))
        .agg(*ohlcv_of_ticks(order_of(ticks, seq)))
        .select(*keys, "ts", *OHLCV)
    )


# ------------------------------------------------------------------ partial bars

#: What of a bar can be merged: the ends' order keys beside their prices, the extremes, the sum.
PARTIAL = ["first_order", "open", "high", "low", "last_order", "close", "volume"]


def partial_bars(ticks: DataFrame, timeframes: dict[str, int], keys: Sequence[str] = ("token",), seq: Sequence[str] | None = None) -> DataFrame:
    """(keys, tf, ts, partial columns) of some ticks for all timeframes {name: seconds}, each a multiple of the shortest.

    Ticks meet once, in the shortest timeframe; the others merge those rows.
    """
    (order,) = order_of(ticks, seq)
    key = F.coalesce(F.col(order).cast("decimal(38,0)"), F.lit(-1))
    shortest = min(timeframes.values())
    ends = [F.min(key).alias("first_order"), *ohlcv_of_ticks((order,)), F.max(key).alias("last_order")]
    fine = ticks.groupBy(*keys, bucket("ts", shortest).alias("ts")).agg(*ends)
    length = F.create_map(*[F.lit(x) for tf in timeframes.items() for x in tf])
    fanned = fine.select(*keys, F.explode(F.array(*[F.lit(t) for t in timeframes])).alias("tf"), "ts", *PARTIAL)
    return merge_partials(fanned.withColumn("ts", bucket("ts", length[F.col("tf")])), [*keys, "tf"])


def merge_partials(partials: DataFrame, keys: Sequence[str] = ("token", "tf")) -> DataFrame:
    """One row per bar of any number of its parts, whatever their order: parts of late ticks mend open and close."""
    merged = partials.groupBy(*keys, "ts").agg(
        F.min("first_order").alias("first_order"),
        F.min_by("open", "first_order").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max("last_order").alias("last_order"),
        F.max_by("close", "last_order").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return merged.select(*keys, "ts", *PARTIAL)


def resample(
    bars: DataFrame,
    timeframes: Sequence[str] = ("15m", "1h", "4h", "1d", "7d"),
    keys: Sequence[str] = ("token",),
    ended_by: Column | None = None,
    origin: int = 0,
) -> DataFrame:
    """All coarser timeframes in one pass; bars with a missing value are dropped.

    ``ended_by`` keeps only bars that ended at or before that instant.
    """
    lengths = F.create_map(*[F.lit(v) for tf in timeframes for v in (tf, TIMEFRAMES[tf])])
    fanned = bars.select(*keys, "ts", *OHLCV, F.explode(F.array(*[F.lit(t) for t in timeframes])).alias("tf"))
    made = (
        fanned.withColumn("_bucket", bucket("ts", lengths[F.col("tf")], origin))
        .groupBy(*keys, "tf", "_bucket")
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_bucket", "ts")
        .dropna(how="any", subset=OHLCV)
    )
    if ended_by is not None:
        made = made.filter(F.unix_seconds("ts") + lengths[F.col("tf")] <= F.unix_seconds(ended_by))
    return made.select(*keys, "tf", "ts", *OHLCV)


def coverage(bars: DataFrame, keys: Sequence[str] = ("token", "tf")) -> DataFrame:
    return bars.groupBy(*keys).agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def coverage_gaps(
    covered: DataFrame, expected: DataFrame, step: Column, start: Column, end: Column, keys: Sequence[str] = ("token", "tf")
) -> DataFrame:
    """Ranges to fetch: the whole window for an empty series, else what lies before its
    first and after its last bar."""
    joined = expected.join(covered, list(keys), "left")
    back = lambda t: F.timestamp_seconds(F.unix_seconds(t) - step)
    ahead = lambda t: F.timestamp_seconds(F.unix_seconds(t) + step)
    gap = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("gap_start"), b.alias("gap_end"))
    ranges = F.array(
        F.when(F.col("min_ts").isNull(), gap("all", start, end)),
        F.when(F.col("min_ts") > start, gap("head", start, F.greatest(start, back("min_ts")))),
        F.when(F.col("max_ts") < end, gap("tail", F.least(end, ahead("max_ts")), end)),
    )
    return joined.select(*keys, F.explode(F.filter(ranges, lambda g: g.isNotNull())).alias("g")).select(*keys, "g.*")


def bar_gaps(bars: DataFrame, step: int, keys: Sequence[str] = ("token",)) -> DataFrame:
    """Every interior run of missing bars, from the distance to the next bar."""
    w = series.block_window(keys)
    found = series.halo_windowed(bars.select(*keys, "ts"), keys, {"_next": F.lead("ts").over(w)}, after=1)
    width = F.unix_seconds("_next") - F.unix_seconds("ts")
    return found.filter(width > step).select(
        *keys,
        F.timestamp_seconds(F.unix_seconds("ts") + step).alias("gap_start"),
        F.timestamp_seconds(F.unix_seconds("_next") - step).alias("gap_end"),
        (F.floor(width / step) - 1).cast("long").alias("missing"),
    )


def drop_incomplete(bars: DataFrame, seconds: int, now: Column | None = None, keys: Sequence[str] = ("token",)) -> DataFrame:
    """Leak-free form: keep bars that ended by ``now``. Without ``now`` the newest row of
    every series goes (its time is found by a hash aggregate, not a sort)."""
    if now is not None:
        return bars.filter(F.unix_seconds("ts") + seconds <= F.unix_seconds(now))
    newest = bars.groupBy(*keys).agg(F.max("ts").alias("_newest"))
    return bars.join(newest, list(keys)).filter(F.col("ts") < F.col("_newest")).drop("_newest")


def latest_n(bars: DataFrame, n: int = 200, keys: Sequence[str] = ("token", "tf"), order: Sequence[str] = ("ts",)) -> DataFrame:
    """The newest ``n`` rows of every series.

    Small ``n``: Spark itself limits each map task to n rows per key before the shuffle.
    Beyond its limit, a first pass over salted keys does the same.
    """
    limit = int(bars.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    newest = [F.col(c).desc() for c in order]
    if n >= limit:
        salted = bars.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
        ranked = Window.partitionBy(*keys, "_salt").orderBy(*newest)
        bars = salted.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    ranked = Window.partitionBy(*keys).orderBy(*newest)
    return bars.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")


def dedupe_last(df: DataFrame, keys: Sequence[str] = ("token", "ts"), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the last row of every key; rank 1 is limited map-side before the shuffle."""
    return latest_n(df, 1, keys, order)


def forward_fill(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("token",), ts: str = "ts", chunk_seconds: int = series.WEEK
) -> DataFrame:
    """Missing values take the last known one of the key, however far back.

    Rows look back inside their (key, calendar chunk); what lies before comes from one row
    per chunk that carries the last known values on.
    """
    keys = list(keys)
    marked = df.withColumn(series.CHUNK, series.chunk_id(ts, chunk_seconds))
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_end_{c}") for c in columns]
    ends = marked.groupBy(*keys, series.CHUNK).agg(*newest)
    earlier = Window.partitionBy(*keys).orderBy(series.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, series.CHUNK, *[F.last(f"_end_{c}", True).over(earlier).alias(f"_old_{c}") for c in columns])
    inside = Window.partitionBy(*keys, series.CHUNK).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, True).over(inside), F.col(f"_old_{c}")) for c in columns}
    return marked.join(carried, [*keys, series.CHUNK]).withColumns(filled).drop(series.CHUNK, *[f"_old_{c}" for c in columns])

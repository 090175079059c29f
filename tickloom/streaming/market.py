"""Structured Streaming forms of the tick, bar and position operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.config import TIMEFRAMES
from tickloom.operators import signals as S
from tickloom.operators.asof import available_at
from tickloom.operators.bars import OHLCV, PARTIAL, merge_partials, ohlcv_of_ticks, order_of, partial_bars, resample
from tickloom.operators.indicators import indicators
from tickloom.operators.store import replace_partitions, touched_partitions, upsert_table
from tickloom.plans.features import feature_table
from tickloom.session import checkpoint, prepare


def tick_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Files of ticks as a stream, oldest first; the number per micro-batch is bounded."""
    return prepare(spark).readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_bars(ticks: DataFrame, seconds: int = 60, delay: str = "1 minute", keys: Sequence[str] = ("token",), seq: Sequence[str] | None = None) -> DataFrame:
    """Candles of closed windows. Ticks later than ``delay`` are dropped and counted by the
    query's ``numRowsDroppedByWatermark``; state holds open windows only."""
    window = F.window("ts", f"{seconds} seconds")
    made = ticks.withWatermark("ts", delay).groupBy(window.alias("_w"), *keys).agg(*ohlcv_of_ticks(order_of(ticks, seq)))
    return made.select(*keys, F.col("_w.start").alias("ts"), "_w", *OHLCV)


def stream_resample(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("token",)) -> DataFrame:
    """Coarser bars chained onto ``stream_bars``: the watermark of the candles carries on."""
    window = F.window(F.window_time("_w"), f"{TIMEFRAMES[timeframe]} seconds")
    made = bars.groupBy(window.alias("_w2"), *keys).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return made.select(*keys, F.lit(timeframe).alias("tf"), F.col("_w2.start").alias("ts"), *OHLCV)


def _span(tf: Column, ts: Column, lengths: dict[str, int], bars: int) -> Column:
    """Name of the partition of a bar: its timeframe and so many bars of that length."""
    length = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])[tf]
    return F.concat_ws("-", tf, F.floor(F.unix_seconds(ts) / (length * bars)).cast("string"))


def mergeable_sink(path: str, timeframes: Sequence[str], keys: Sequence[str] = ("token",), seq: Sequence[str] | None = None, span_bars: int = 1024) -> Callable[[DataFrame, int], None]:
    """Sink of a tick stream: bars of all timeframes that ticks of any lateness mend.

    A batch's ticks become partial bars, which merge with those stored in ``path``/bars. Only the partitions of bars that
    the batch changes are read and replaced (``span_bars`` of one length each); base bars are not read again for coarser
    ones. A stored row keeps what earlier batches made of the bar (``old``) beside the part of the last one (``new``), so a
    replayed batch replaces its own part and counts once. ``stored_bars`` reads the bars.
    """
    lengths = {tf: TIMEFRAMES[tf] for tf in timeframes}
    keys = [*keys, "tf"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        made = checkpoint(partial_bars(batch, lengths, keys[:-1], seq))
        if made.isEmpty():
            return
        fresh = made.select(*keys, "ts", F.struct(*PARTIAL).alias("fresh"), _span(F.col("tf"), F.col("ts"), lengths, span_bars).alias("span"))
        rows = fresh.select(*keys, "ts", F.lit(None).cast(fresh.schema["fresh"].dataType).alias("old"), F.col("fresh").alias("new"), F.lit(batch_id).cast("long").alias("batch"), "span")
        if _exists(spark, f"{path}/bars"):
            stored = touched_partitions(spark.read.schema(rows.schema).parquet(f"{path}/bars"), fresh, "span")
            both = stored.join(fresh, [*keys, "ts", "span"], "full_outer")
            again = F.col("batch") >= batch_id
            # what this batch adds to: all that others brought
            olds = F.filter(F.array(F.col("old"), F.when(~F.coalesce(again, F.lit(False)), F.col("new"))), lambda x: x.isNotNull())
            kept = both.filter("fresh IS NULL").select(*rows.columns)
            changed = both.filter("fresh IS NOT NULL").select(*keys, "ts", "fresh", "span", olds.alias("olds"))
            merged = changed.withColumn("old", F.aggregate("olds", F.lit(None).cast(fresh.schema["fresh"].dataType), lambda acc, x: _joined(acc, x)))
            rows = kept.unionByName(merged.select(*keys, "ts", "old", F.col("fresh").alias("new"), F.lit(batch_id).cast("long").alias("batch"), "span"))
        replace_partitions(spark, f"{path}/bars", rows.hint("rebalance", "span"), "span")

    return run


def _joined(a: Column, b: Column) -> Column:
    """Two partial bars of one bar in one; either may be NULL."""
    first = F.least(a["first_order"], b["first_order"]).eqNullSafe(a["first_order"])
    last = F.greatest(a["last_order"], b["last_order"]).eqNullSafe(a["last_order"])
    merged = F.struct(
        F.least(a["first_order"], b["first_order"]).alias("first_order"),
        F.when(first, a["open"]).otherwise(b["open"]).alias("open"),
        F.greatest(a["high"], b["high"]).alias("high"),
        F.least(a["low"], b["low"]).alias("low"),
        F.greatest(a["last_order"], b["last_order"]).alias("last_order"),
        F.when(last, a["close"]).otherwise(b["close"]).alias("close"),
        (a["volume"] + b["volume"]).alias("volume"),
    )
    plain = F.struct(*[b[c].alias(c) for c in PARTIAL])
    return F.when(a.isNull(), plain).otherwise(merged)


def stored_bars(spark: SparkSession, path: str, keys: Sequence[str] = ("token",)) -> DataFrame:
    """The bars that ``mergeable_sink`` has stored."""
    rows = spark.read.parquet(f"{path}/bars")
    parts = [rows.filter(F.col(p).isNotNull()).select(*keys, "tf", "ts", f"{p}.*") for p in ("old", "new")]
    return merge_partials(parts[0].unionByName(parts[1]), [*keys, "tf"]).select(*keys, "tf", "ts", *OHLCV)


def cascade_sink(path: str, timeframes: Sequence[str], seconds: int, keys: Sequence[str] = ("token",)) -> Callable[[DataFrame, int], None]:
    """Sink of a stream of closed bars of ``seconds``: all coarser timeframes from that one
    stream. Base bars go to ``path``/base by span of the longest timeframe; a coarser bar is written to ``path``/rows by the
    batch whose bars reach its end. A batch reads the spans of its own bars and those its open bars began in, no others,
    and one number that the batch before left."""
    length = F.create_map(*[F.lit(x) for tf in timeframes for x in (tf, TIMEFRAMES[tf])])
    longest = max(TIMEFRAMES[tf] for tf in timeframes)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        span = F.floor(F.unix_seconds("ts") / longest).alias("span")
        batch.select(*keys, "ts", *OHLCV, span).write.mode("overwrite").partitionBy("span").parquet(f"{path}/base/batch={batch_id}")
        earlier = None
        if batch_id > 0 and _exists(spark, f"{path}/reached/batch={batch_id - 1}"):
            earlier = spark.read.parquet(f"{path}/reached/batch={batch_id - 1}").first().now
        now = spark.read.schema(batch.schema).parquet(f"{path}/base/batch={batch_id}").agg(F.max(F.unix_seconds("ts") + seconds)).first()[0]
        reached = max((t for t in (earlier, now) if t is not None), default=None)
        spark.createDataFrame([(reached,)], "now long").coalesce(1).write.mode("overwrite").parquet(f"{path}/reached/batch={batch_id}")
        if now is None or reached == earlier:
            return
        named = [*batch.select(*keys, "ts", *OHLCV).schema, T.StructField("batch", T.LongType()), T.StructField("span", T.LongType())]
        stored = spark.read.schema(T.StructType(named)).parquet(f"{path}/base")
        recent = stored.filter(F.col("batch") <= batch_id)
        if earlier is not None:
            recent = recent.filter((F.col("span") >= (earlier - longest) // longest) & (F.unix_seconds("ts") >= earlier - longest))
        ends = F.unix_seconds("ts") + length[F.col("tf")]
        made = resample(recent, timeframes, keys).filter(ends <= reached)
        if earlier is not None:
            made = made.filter(ends > earlier)
        made.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Run a stream into ``sink(batch, id)``; the checkpoint makes batches replayable, so a
    sink must be idempotent per batch id (write to a folder of that id, or upsert)."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Every micro-batch overwrites its own folder: a replay leaves one copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upsert_sink(path: str, keys: Sequence[str], partition: str, order: Sequence[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Change-only upsert of every micro-batch into a stored table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch.sparkSession, path, batch, keys, partition, order)

    return write


def live_cycle(
    history: Callable[[SparkSession], DataFrame],
    predict: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame, int], None],
    balance: float,
    windows: dict,
    roles: dict[str, str],
    events: Callable[[SparkSession], DataFrame] | None = None,
    halted: Callable[[], bool] = lambda: False,
    look_back: str | None = None,
    atr_window: int = 14,
) -> Callable[[DataFrame, int], None]:
    """Sink of a bar stream: features of every closed bar of the batch, predictions, directive,
    stop from the latest ATR of the second timeframe, size.

    ``history`` reads the stored bars; they are cut to what the batch can see: nothing after its
    last bar and, with ``look_back`` (an interval such as ``"90 days"``, at least three times the
    longest window), nothing long before its first. ``predict`` turns feature rows into
    (token, ts, model, label, prob).
    """
    keys = ["token", "ts"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("token", F.lit(roles["15m"]).alias("tf"), "ts", *OHLCV)
        span = batch.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
        if span.low is None:
            return
        bars = history(spark).join(fresh.select("token").distinct(), "token", "left_semi").filter(F.col("ts") <= F.lit(span.high))
        if look_back:
            bars = bars.filter(F.col("ts") >= F.lit(span.low) - F.expr(f"INTERVAL {look_back}"))
        bars = bars.select(*fresh.columns).join(fresh.select("token", "tf", "ts"), ["token", "tf", "ts"], "left_anti").unionByName(fresh)
        rows = feature_table(bars, events(spark) if events else None, windows, roles).join(fresh.select(*keys), keys, "left_semi")
        priced = predict(rows).join(fresh.select(*keys, F.col("close").alias("entry_price")), keys)
        directives = S.consensus(priced, by=keys, entry_price="entry_price")
        second = roles["1h"]
        atr = available_at(indicators(bars.filter(F.col("tf") == second), atr=atr_window, null_head=True).select(*keys, "atr"), TIMEFRAMES[second])
        opened = S.trade_params(directives, atr)
        sized = opened.withColumn("size", S.position_size(F.lit(balance), F.col("entry_price"), F.col("stop_loss")))
        write(S.admissible(sized, halted=halted()), batch_id)

    return run

"""Stops and targets of open positions as a state machine over two streams, ticks and position changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.trades import SHORT_WORDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "direction string, stop_loss double, take_profit double, entry_us long, expires_us long"
OUTPUT = "position_id string, token string, direction string, trigger_ts timestamp, trigger_price double, reason string"
NEVER = np.iinfo(np.int64).max


def first_hit(price: np.ndarray, stop: float, target: float, short: bool) -> int:
    """The first price at or beyond the stop or the target, -1 if none is."""
    hit = (price >= stop) | (price <= target) if short else (price <= stop) | (price >= target)
    at = int(hit.argmax()) if len(hit) else 0
    return at if len(hit) and hit[at] else -1


class PositionMonitor(StatefulProcessor):
    """Open positions of one (token, part). The first tick after a position's entry that reaches its stop or target ends it and
    its state; a stop counts before a target. A change ``close`` ends a position at its instant, and so does a timer at
    ``expires_ts``, both without a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.positions = handle.getMapState("positions", "position_id string", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch of one key; the sources bound its size
        batch = pd.concat(list(rows), ignore_index=True)
        token = key[0]
        ticks = batch[batch["kind"] == "tick"].sort_values(["us", "seq"], kind="stable")
        us, price = ticks["us"].to_numpy(np.int64), ticks["price"].to_numpy(np.float64)
        lowest, highest = (np.minimum.accumulate(price), np.maximum.accumulate(price)) if len(price) else (price, price)
        known = {k[0]: tuple(v) for k, v in self.positions.iterator()}
        stored = set(known)
        opened = batch[batch["kind"] == "open"].sort_values("us", kind="stable")
        for row in opened.itertuples():
            if row.position_id in known:
                continue  # a change that arrived twice
            expires = NEVER if pd.isna(row.expires_us) else int(row.expires_us)
            known[row.position_id] = (row.direction, float(row.stop_loss), float(row.take_profit), int(row.us), expires)
            if expires != NEVER:
                self.handle.registerTimer(expires // 1000)
        closed = batch[batch["kind"] == "close"].groupby("position_id")["us"].min().to_dict()
        found = []
        for name, (direction, stop, target, entry, expires) in known.items():
            short = direction.lower() in SHORT_WORDS
            until = min(closed.get(name, NEVER), expires)
            first = int(np.searchsorted(us, entry, "right"))
            last = int(np.searchsorted(us, until, "right")) if until != NEVER else len(us)
            if first == 0:
                # ticks before an old position's entry are gone: running extremes tell where it ends
                a = np.searchsorted(highest, stop) if short else np.searchsorted(-lowest, -stop)
                b = np.searchsorted(-lowest, -target) if short else np.searchsorted(highest, target)
                hit = int(min(a, b))
            else:
                hit = first + first_hit(price[first:last], stop, target, short) if first < last else -1
                hit = hit if hit >= first else last
            if hit < last:
                p = float(price[hit])
                stopped = p >= stop if short else p <= stop
                found.append((name, token, direction, int(us[hit]), p, "STOP_LOSS" if stopped else "TAKE_PROFIT"))
            if hit < last or name in closed:
                if name in stored:
                    self.positions.removeKey((name,))
            elif name not in stored:
                self.positions.updateValue((name,), (direction, stop, target, entry, expires))
        yield self._rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for name in [k[0] for k, v in self.positions.iterator() if v[4] <= now + 999]:
            self.positions.removeKey((name,))
        yield self._rows([])

    def _rows(self, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["position_id", "token", "direction", "trigger_ts", "trigger_price", "reason"])
        out["trigger_ts"] = pd.to_datetime(out["trigger_ts"].astype("int64"), unit="us", utc=True)
        out["trigger_price"] = out["trigger_price"].astype("float64")
        return out

    def close(self) -> None:
        pass


def monitored(ticks: DataFrame, changes: DataFrame, delay: str = "1 hour", seq: str = "tick_id", parts: int = 4) -> DataFrame:
    """First hits of open positions, for streams.

    ``ticks``: token, ts, price and a number ``seq`` that orders ticks of one instant. ``changes``: position_id, token,
    direction, ts, stop_loss, take_profit and, if there are, ``change`` (open or close) and ``expires_ts``. A position has to arrive
    with the ticks after its entry or before them. Positions of a token are dealt out to ``parts`` keys and its ticks go to
    each of them, so that a hot token's positions aren't one task's. State holds what is open and nothing else.
    """
    none = lambda kind: F.lit(None).cast(kind)
    there = set(changes.columns)
    all_parts = F.explode(F.array(*[F.lit(k) for k in range(parts)]))
    tick_rows = ticks.filter(F.col("price").isNotNull() & ~F.isnan("price")).select(
        F.lit("tick").alias("kind"), "token", all_parts.alias("part"), "ts", F.unix_micros("ts").alias("us"), F.col(seq).cast("long").alias("seq"), "price",
        none("string").alias("position_id"), none("string").alias("direction"), none("double").alias("stop_loss"), none("double").alias("take_profit"), none("long").alias("expires_us"),
    )
    change_rows = changes.select(
        (F.col("change") if "change" in there else F.lit("open")).alias("kind"),
        "token",
        F.pmod(F.xxhash64("position_id"), F.lit(parts)).cast("int").alias("part"),
        "ts",
        F.unix_micros("ts").alias("us"),
        none("long").alias("seq"),
        none("double").alias("price"),
        "position_id",
        "direction",
        "stop_loss",
        "take_profit",
        (F.unix_micros("expires_ts") if "expires_ts" in there else none("long")).alias("expires_us"),
    )
    rows = tick_rows.unionByName(change_rows).filter("token IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return rows.groupBy("token", "part").transformWithStateInPandas(
        statefulProcessor=PositionMonitor(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", eventTimeColumnName=""
    )


def run_monitor(spark: SparkSession, hits: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the hits to ``path``. A query takes its settings when it starts; the session's own are put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        writer = hits.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(name, before)

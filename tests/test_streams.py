"""Order of ticks, mergeable bars and the position state machine."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.sources import payloads as P
from tickloom.streaming import market as R, positions as PM

TICK = "token string, s double, price double, qty double, tick_id long"


def ticks_of(frame, rows):
    return frame(rows, TICK).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")


def messages(frame, rows):
    """(symbol, second, price, sequence or None) as trade messages."""
    texts = []
    for symbol, second, price, sequence in rows:
        m = {"type": "trade", "symbol_id": symbol, "time_exchange": f"2024-01-01T00:00:{second:09.6f}0Z", "price": str(price), "size": "1"}
        texts.append((json.dumps(m | ({} if sequence is None else {"sequence": sequence})),))
    return frame(texts, "value string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "rows, want",
    [
        # no sequence at all
        ([("X_SPOT_A_USDT", 1, 5.0, None), ("X_SPOT_A_USDT", 2, 7.0, None)], (5.0, 7.0)),
        # each market counts for itself
        ([("X_SPOT_A_USDT", 1, 1.0, 900), ("Y_SPOT_A_USDT", 9, 2.0, 5)], (1.0, 2.0)),
        # one instant: the sequence tells, also from none
        ([("X_SPOT_A_USDT", 1, 3.0, 9), ("X_SPOT_A_USDT", 1, 2.0, 8), ("X_SPOT_A_USDT", 1, 4.0, 10)], (2.0, 4.0)),
        # microseconds count, though ts is cut to milliseconds
        ([("X_SPOT_A_USDT", 1.000900, 3.0, 1), ("X_SPOT_A_USDT", 1.000100, 2.0, 2)], (2.0, 3.0)),
        ([("X_SPOT_A_USDT", 1, 3.0, 9223372036854775807), ("X_SPOT_A_USDT", 2, 2.0, 1)], (3.0, 2.0)),
    ],
)
def test_ticks_are_ordered_by_time_market_and_sequence(frame, rows, want):
    for order in (rows, rows[::-1]):
        made = B.ticks_to_bars(P.decode_trades(messages(frame, order)), 60)
        (bar,) = made.collect()
        assert (bar.open, bar.close) == want
    assert "HashAggregate" in plan_of(made) and "SortAggregate" not in plan_of(made)


def test_ticks_without_any_order_keep_open_and_close(frame):
    (bar,) = B.ticks_to_bars(ticks_of(frame, [("a", 1.0, 5.0, 1.0, None), ("a", 2.0, 7.0, 1.0, 3)])).collect()
    assert (bar.open, bar.close) == (5.0, 7.0)


def test_equal_ticks_have_the_same_order_in_every_run(frame):
    rows = [("X_SPOT_A_USDT", 1, p, None) for p in (3.0, 2.0, 9.0, 4.0)]
    bars = {B.ticks_to_bars(P.decode_trades(messages(frame, r)), 60).first()[:] for r in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(bars) == 1


ROWS = [("a" if i % 3 else "b", 13.0 * i + 0.5, 100.0 + (i * 37) % 50, 1.0, i) for i in range(3000)]
NAMES = ["1m", "15m", "1h", "4h"]


def bars_of(frame):
    minutes = B.ticks_to_bars(ticks_of(frame, ROWS), 60)
    both = minutes.selectExpr("token", "'1m' tf", "ts", *B.OHLCV).unionByName(B.resample(minutes, NAMES[1:]))
    return sorted(map(tuple, both.collect()))


def test_parts_of_bars_merge_in_any_order(frame):
    ticks = ticks_of(frame, ROWS)
    lengths = {tf: s for tf, s in (("1m", 60), ("15m", 900), ("1h", 3600), ("4h", 14400))}
    parts = [B.partial_bars(ticks.filter(f"tick_id % 7 = {k}"), lengths) for k in (3, 0, 6, 1, 5, 2, 4)]
    nested = B.merge_partials(B.merge_partials(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    for p in parts[3:]:
        nested = nested.unionByName(p)
    made = B.merge_partials(nested).select("token", "tf", "ts", *B.OHLCV)
    assert sorted(map(tuple, made.collect())) == bars_of(frame)


def test_late_and_replayed_batches_mend_stored_bars(spark, frame, tmp_path):
    """Batches out of order, one of them twice and one replayed with other cuts; only touched partitions are replaced."""
    path = str(tmp_path / "store")
    sink = R.mergeable_sink(path, NAMES, span_bars=20)
    ticks = ticks_of(frame, ROWS)
    cut = lambda a, b: ticks.filter(f"tick_id >= {a} AND tick_id < {b}")
    sink(cut(2000, 3000), 0)
    sink(cut(0, 800), 1)
    sink(cut(0, 800), 1)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store/bars").rglob("*.parquet")}
    sink(cut(800, 805), 2)
    left = [f for f, t in files.items() if f.exists() and f.stat().st_mtime_ns == t]
    assert len(left) > len(files) // 2  # partitions without a changed bar stay as they are
    sink(cut(805, 2000), 3)
    sink(ticks.limit(0), 4)
    assert sorted(map(tuple, R.stored_bars(spark, path).select("token", "tf", "ts", *B.OHLCV).collect())) == bars_of(frame)


def test_cascade_reads_recent_spans_only(spark, frame, tmp_path):
    minutes = B.ticks_to_bars(ticks_of(frame, ROWS), 60)
    path = str(tmp_path / "cascade")
    sink = R.cascade_sink(path, ["15m", "1h"], 60)
    edges = [0, 9000, 9060, 20000, 39000]
    cuts = [minutes.filter((F.unix_seconds("ts") >= a) & (F.unix_seconds("ts") < b)) for a, b in zip(edges, edges[1:])]
    for k, part in enumerate(cuts):
        sink(part, k)
        sink(part, k)  # a replay leaves one copy
    end = F.unix_seconds("ts") + F.when(F.col("tf") == "1h", 3600).otherwise(900)
    want = B.resample(minutes, ["15m", "1h"]).filter(end <= minutes.agg(F.max(F.unix_seconds("ts") + 60)).first()[0])
    got = spark.read.parquet(f"{path}/rows").select("token", "tf", "ts", *B.OHLCV)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


CHANGE = "position_id string, token string, direction string, s double, stop_loss double, take_profit double, change string, e double"


def changes_of(frame, rows):
    at = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("long"))
    return frame(rows, CHANGE).withColumns({"ts": at("s"), "expires_ts": at("e")}).drop("s", "e")


def test_position_states_end(spark, frame, tmp_path):
    """Hits over several runs of one query; triggered, closed and expired positions leave no state."""
    waves = [
        (
            [("BTC", 10.0, 50_000.0, 1.0, 1), ("BTC", 20.0, 49_500.0, 1.0, 2)],
            [
                ("stop", "BTC", "long", 5.0, 49_000.0, 60_000.0, "open", None),
                ("target", "BTC", "short", 15.0, 70_000.0, 49_500.0, "open", None),
                ("both", "BTC", "long", 5.0, 50_000.0, 50_000.0, "open", None),
                ("closed", "BTC", "long", 5.0, 49_300.0, None, "open", None),
                ("expired", "BTC", "long", 5.0, 48_000.0, None, "open", 45.0),
                ("stays", "BTC", "SELL", 5.0, 90_000.0, 1.0, "open", None),
                ("other", "ETH", "long", 5.0, 49_000.0, 60_000.0, "open", None),
            ],
        ),
        ([("BTC", 30.0, float("nan"), 1.0, 3), ("BTC", 40.0, 49_200.0, 1.0, 4)], [("closed", "BTC", "long", 35.0, None, None, "close", None), ("stop", "BTC", "long", 5.0, 49_000.0, 60_000.0, "open", None)]),
        ([("BTC", 50.0, 48_999.0, 1.0, 5), ("BTC", 51.0, 40_000.0, 1.0, 6), ("BTC", 4000.0, 47_000.0, 1.0, 7)], []),
        ([("BTC", 9000.0, 47_500.0, 1.0, 8)], []),
    ]
    path = str(tmp_path)
    for ticks, changes in waves:
        t, c = ticks_of(frame, ticks), changes_of(frame, changes)
        t.write.mode("append").parquet(f"{path}/ticks")
        c.write.mode("append").parquet(f"{path}/changes")
        streams = (R.tick_stream(spark, f"{path}/{name}", df.schema) for name, df in (("ticks", t), ("changes", c)))
        PM.run_monitor(spark, PM.monitored(*streams, delay="10 minutes", parts=2), f"{path}/hits", f"{path}/state").awaitTermination()
    hits = {r.position_id: (r.s, r.trigger_price, r.reason) for r in spark.read.parquet(f"{path}/hits").withColumn("s", F.unix_seconds("trigger_ts")).collect()}
    assert hits == {
        "stop": (50, 48_999.0, "STOP_LOSS"),
        "target": (20, 49_500.0, "TAKE_PROFIT"),
        "both": (10, 50_000.0, "STOP_LOSS"),
    }
    held = spark.read.format("statestore").option("stateVarName", "positions").load(f"{path}/state")
    assert {r[0] for r in held.select("key.position_id" if "position_id" in str(held.schema["key"].dataType) else F.col("user_map_key.position_id")).collect()} == {"stays", "other"}


def test_monitor_keeps_the_sessions_settings(spark, frame, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    ticks_of(frame, ROWS[:5]).write.parquet(str(tmp_path / "t"))
    changes_of(frame, []).write.parquet(str(tmp_path / "c"))
    streams = (R.tick_stream(spark, str(tmp_path / d), spark.read.parquet(str(tmp_path / d)).schema) for d in "tc")
    PM.run_monitor(spark, PM.monitored(*streams), str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    assert spark.conf.get(name) == before and spark.read.parquet(str(tmp_path / "h")).count() == 0

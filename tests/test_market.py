"""Bars, sessions, as-of joins and streams: pinned values and invariants."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions import temporal, timeparse
from tickloom.operators import asof, bars as B
from tickloom.streaming import market as R

TICK = "token string, s double, price double, qty double, tick_id long"


def ticks_16m(frame):
    rows, k = [], 0
    for m in range(16):
        for s, p, q in ((5, 100, 1), (20, 105, 2), (55, 99, 4), (59, 102, 3)):
            rows.append(("X", 1672531200.0 + 60 * m + s, float(p + m), float(q), k))
            k += 1
    rows.append(("X", 1672531200.0 + 60 * 16 + 1, 200.0, 1.0, k))
    df = frame(rows, TICK)
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")


def values(row):
    return (row.open, row.high, row.low, row.close, row.volume)


def test_minute_and_quarter_bars(frame):
    minutes = B.ticks_to_bars(ticks_16m(frame), 60)
    first = minutes.orderBy("ts").first()
    assert values(first) == (100, 105, 99, 102, 10)
    quarter = B.resample(minutes, ["15m"], ended_by=F.lit("2023-01-01 00:16:00").cast("timestamp"))
    assert [values(r) for r in quarter.collect()] == [(100, 119, 99, 116, 150)]


def test_weeks_start_on_the_epoch_weekday(frame):
    df = frame([("2024-01-03 23:00:00",), ("2024-01-04 00:00:00",)], "t string").select(B.bucket(F.col("t").cast("timestamp"), 604800).cast("string").alias("w"))
    assert [r.w for r in df.collect()] == ["2023-12-28 00:00:00", "2024-01-04 00:00:00"]


SESSION_CASES = [
    # time, since open, to close, kz since, kz left, flag that must be set
    ("2024-01-05 06:45:00", 31, 1, 0, 0, "sess_asia_flag"),
    ("2024-01-05 07:00:00", 0, 32, 0, 8, "sess_london_flag"),
    ("2024-01-05 08:45:00", 7, 25, 7, 1, "kz_london_flag"),
    ("2024-01-05 09:00:00", 8, 24, 8, 0, "kz_london_flag"),
    ("2024-01-05 09:15:00", 9, 23, 0, 0, "friday_flag"),
    ("2024-01-05 14:45:00", 31, 1, 0, 0, "sess_london_flag"),
    ("2024-01-05 15:00:00", 0, 32, 0, 8, "sess_ny_flag"),
    ("2024-01-12 17:00:00", 8, 24, 8, 0, "kz_ny_flag"),
    ("2024-01-08 23:00:00", 0, 32, 0, 0, "sess_asia_flag"),
    ("2024-01-09 00:00:00", 4, 28, 0, 0, "sess_asia_flag"),
    ("2024-01-08 08:30:00", 6, 26, 6, 2, "sess_london_flag"),
]


def test_sessions(frame):
    df = frame([(c[0],) for c in SESSION_CASES], "t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.t: r for r in temporal.with_session_features(df).collect()}
    for t, since, left, kz, kz_left, flag in SESSION_CASES:
        r = got[t]
        assert (r.bars_since_session_open, r.bars_to_session_close, r.bars_since_kz_start, r.bars_to_kz_end) == (since, left, kz, kz_left), t
        assert r[flag] == 1.0, (t, flag)
    assert got["2024-01-05 15:00:00"].sess_london_flag == 1.0 and got["2024-01-08 23:00:00"].sess_ny_flag == 1.0
    assert got["2024-01-08 08:30:00"].friday_flag == 0.0


def test_timestamps(frame):
    same = ["2025-09-05T04:13:00Z", "2025-09-05T06:13:00+02:00", "2025-09-05 04:13:00", "1757045580", "1757045580000", "2025-09-05T04:13:00.0000000Z"]
    df = frame([(s,) for s in same + ["nonsense", None]], "raw string")
    rows = timeparse.with_parsed_ts(df, "raw").select("raw", F.col("ts").cast("string").alias("t"), "is_bad").collect()
    assert {r.t for r in rows if r.raw in same} == {"2025-09-05 04:13:00"}
    assert [(r.t, r.is_bad) for r in rows if r.raw not in same] == [(None, True), (None, False)]


def test_epoch_unit_at_exactly_half(frame):
    for numbers in ([1.0, 2e12], [1.0, 1.5e12], [5.0, 6.0, 2e12], [5.0, 2e12, 3e12]):
        unit = timeparse.epoch_unit(frame([(v,) for v in numbers], "v double"), "v").first().unit
        assert unit == ("ms" if np.median(numbers) >= 1e12 else "s"), numbers


def random_sides(frame, seed):
    rng = np.random.default_rng(seed)
    left = pd.DataFrame({"token": rng.choice(["hot", "hot", "b"], 300), "at": rng.integers(0, 5000, 300)})
    right = pd.DataFrame({"token": rng.choice(["hot", "b"], 60), "at": rng.integers(0, 5000, 60)}).drop_duplicates()
    right["v"] = right["at"] * 10
    make = lambda p, s: frame([tuple(x) for x in p.itertuples(index=False)], s)
    return left, right, make(left, "token string, at long"), make(right, "token string, at long, v long")


def test_asof_matches_pandas(frame):
    for direction in ("backward", "forward", "nearest"):
        left, right, dl, dr = random_sides(frame, 7)
        got = asof.asof_join(dl, {"r": dr}, on="at", direction=direction, tolerance=400, chunk=150).select("token", "at", F.col("r.v").alias("v")).toPandas()
        want = pd.merge_asof(left.sort_values("at"), right.sort_values("at"), on="at", by="token", direction=direction, tolerance=400)
        key = lambda p: sorted((t, int(a), None if pd.isna(v) else int(v)) for t, a, v in p[["token", "at", "v"]].itertuples(index=False))
        assert str(key(got)) == str(key(want)), direction


def test_asof_never_looks_ahead(frame):
    base = frame([("t", 900 * i) for i in range(20)], "token string, s long").select("token", F.timestamp_seconds("s").alias("ts"))
    hours = frame([("t", 3600 * i, i) for i in range(5)], "token string, s long, h int").select("token", F.timestamp_seconds("s").alias("ts"), "h")
    joined = asof.asof_join(base, {"r": asof.available_at(hours, 3600)}).select("ts", F.col("r.h").alias("h"))
    for r in joined.select(F.unix_seconds("ts").alias("s"), "h").collect():
        assert r.h == (None if r.s < 3600 else r.s // 3600 - 1)


def test_event_flag_is_exact_at_the_tolerance(frame):
    rows = frame([(s,) for s in (0, 100, 7200, 7300, 50000)], "s long").withColumn("ts", F.timestamp_seconds("s"))
    events = frame([(3600,), (3700,)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    got = {r.s: r.economic_event for r in asof.event_flag(rows, events, 3600).collect()}
    assert got == {0: True, 100: True, 7200: True, 7300: True, 50000: False}
    got = {r.s: r.economic_event for r in asof.event_flag(rows, events, 3599).collect()}
    assert got == {0: False, 100: False, 7200: True, 7300: False, 50000: False} or got[7300] is False


def test_gaps(frame):
    df = frame([("t", 3600 * i) for i in (0, 1, 4, 5, 9)], "token string, s long").select("token", F.timestamp_seconds("s").alias("ts"))
    rows = B.bar_gaps(df, 3600).select(F.unix_seconds("gap_start").alias("a"), F.unix_seconds("gap_end").alias("b"), "missing").orderBy("a").collect()
    assert [(r.a // 3600, r.b // 3600, r.missing) for r in rows] == [(2, 3, 2), (6, 8, 3)]


def test_latest_n_beyond_the_rank_limit(spark):
    df = spark.range(5000).select(F.lit("t").alias("token"), F.lit("1m").alias("tf"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), "id")
    got = B.latest_n(df, 1500)
    assert got.agg(F.min("id"), F.max("id"), F.count("id")).first()[:] == (3500, 4999, 1500)


def test_stream_equals_batch_and_drops_late_ticks(spark, frame, tmp_path):
    ticks = ticks_16m(frame)
    late = frame([("X", 1672531200.0 + 30, 1.0, 1.0, 999)], TICK).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    flush = frame([("X", 1672531200.0 + 86400, 1.0, 1.0, 1000)], TICK).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    for i, part in enumerate([ticks.filter("tick_id < 30"), ticks.filter("tick_id >= 30"), late, flush]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = R.tick_stream(spark, str(tmp_path / "in"), ticks.schema, max_files=1)
    for name, made in (("bars", R.stream_bars(stream).drop("_w")), ("quarters", R.stream_resample(R.stream_bars(stream), "15m").drop("tf"))):
        R.start(made, R.batch_folder_sink(str(tmp_path / name)), str(tmp_path / f"{name}_state")).awaitTermination()
        got = spark.read.schema(made.schema).parquet(str(tmp_path / name) + "/*")
        want = B.ticks_to_bars(ticks, 60) if name == "bars" else B.resample(B.ticks_to_bars(ticks, 60), ["15m"]).drop("tf")
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))

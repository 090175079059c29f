"""Indicators against plain sequential recurrences, on layouts of one and of many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as I, series


def walk(spark, tokens=("hot", "cold"), rows=(900, 60), seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for token, n in zip(tokens, rows):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        span = np.abs(rng.normal(0, 1, n)) + 0.1
        gaps = np.cumsum(rng.integers(1, 40, n))
        for i in range(n):
            out.append((token, int(1_700_000_000 + 900 * gaps[i]), float(close[i]), float(close[i] + span[i]), float(close[i] - span[i])))
    df = spark.createDataFrame(out, "token string, s long, close double, high double, low double")
    return df.select("token", F.timestamp_seconds("s").alias("ts"), F.col("close").alias("open"), "high", "low", "close", F.lit(1.0).alias("volume"))


def sequential(g, nr, na, nd):
    h, lo, c = (g[x].to_numpy() for x in ("high", "low", "close"))
    n = len(g)
    pc = np.r_[np.nan, c[:-1]]
    tr = np.fmax(h - lo, np.fmax(abs(h - pc), abs(lo - pc)))
    atr = np.zeros(n)
    atr[na - 1] = tr[:na].mean()
    for i in range(na, n):
        atr[i] = (atr[i - 1] * (na - 1) + tr[i]) / na

    def ew(x):
        y = np.array(x, dtype=float)
        for i in range(1, n):
            y[i] = (1 - 1 / nr) * y[i - 1] + x[i] / nr
        return y

    d = np.r_[0, np.diff(c)]
    gain, loss = ew(np.where(d > 0, d, 0)), ew(np.where(d < 0, -d, 0))
    with np.errstate(all="ignore"):
        rsi = np.where(loss == 0, 100, 100 - 100 / (1 + gain / loss))
    rsi[: nr - 1] = np.nan
    up, dn = np.r_[np.nan, np.diff(h)], -np.r_[np.nan, np.diff(lo)]
    plus, minus = np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)

    def wilder(x):
        y = np.zeros(n)
        y[nd] = x[1 : nd + 1].sum()
        for i in range(nd + 1, n):
            y[i] = y[i - 1] - y[i - 1] / nd + x[i]
        return y

    t, p, m = wilder(tr), wilder(plus), wilder(minus)
    with np.errstate(all="ignore"):
        dip, din = np.nan_to_num(100 * p / t), np.nan_to_num(100 * m / t)
        dx = np.nan_to_num(100 * abs(dip - din) / (dip + din))
    adx = np.zeros(n)
    adx[2 * nd - 1] = dx[nd : 2 * nd].mean()
    for i in range(2 * nd, n):
        adx[i] = (adx[i - 1] * (nd - 1) + dx[i]) / nd
    dip[: nd + 1], din[: nd + 1] = 0, 0
    return {"rsi": rsi, "atr": atr, "adx": adx, "adx_pos": dip, "adx_neg": din}


def check(df, nr, na, nd):
    for _, g in df.sort_values(["token", "ts"]).groupby("token"):
        for name, want in sequential(g, nr, na, nd).items():
            got = g[name].to_numpy(dtype=float)
            assert (np.isnan(got) == np.isnan(want)).all(), name
            assert np.nanmax(abs(got - want)) < 1e-8, name


@pytest.mark.parametrize("windows", [(14, 14, 14), (14, 20, 10), (3, 2, 1)])
def test_indicators_match_sequential(spark, windows):
    check(I.indicators(walk(spark), *windows).toPandas(), *windows)


def test_many_blocks_and_halos(spark, monkeypatch):
    whole = series.layout
    monkeypatch.setattr(series, "layout", lambda ws, lead_in=2: (whole(ws, lead_in)[1] + 7, whole(ws, lead_in)[1]))
    check(I.indicators(walk(spark), 5, 4, 3).toPandas(), 5, 4, 3)


def test_rebased_scan(spark, monkeypatch):
    monkeypatch.setattr(series, "RESCALE", 60.0)
    check(I.indicators(walk(spark), 5, 12, 3).toPandas(), 5, 12, 3)


def test_sweep_equals_single_runs(spark):
    bars = walk(spark).withColumn("tf", F.lit("1h"))
    params = [{"param_id": "a", "tf": "1h", "rsi": 5, "atr": 4, "adx": 3}, {"param_id": "b", "tf": "1h", "rsi": 14, "atr": None, "adx": 7}]
    swept = I.sweep(bars, params)
    check(swept.filter("param_id = 'a'").toPandas(), 5, 4, 3)
    b = swept.filter("param_id = 'b'")
    assert b.filter("atr IS NOT NULL").count() == 0
    single = I.indicators(bars, rsi=14, adx=7)
    joined = b.alias("b").join(single.alias("s"), ["token", "ts"])
    assert joined.filter("abs(b.rsi - s.rsi) > 1e-9 OR abs(b.adx - s.adx) > 1e-9 OR (b.rsi IS NULL) <> (s.rsi IS NULL)").count() == 0


def test_sweep_names_the_missing_parameter(spark):
    with pytest.raises(KeyError, match="params/tf"):
        I.sweep(walk(spark).withColumn("tf", F.lit("1h")), [{"param_id": "a", "rsi": 5}])


def test_ewm_carries_over_missing_values(spark, frame):
    rows = [("t", i, v) for i, v in enumerate([None, 10.0, None, 20.0, float("nan"), 20.0])]
    df = frame(rows, "token string, s long, x double").withColumn("ts", F.timestamp_seconds(F.col("s") * 60))
    got = [r.ewm for r in I.ewm(df, "x", 2).orderBy("ts").collect()]
    assert got == [None, 10.0, 10.0, 15.0, 15.0, 17.5]


def test_atr_normalized_vector(frame):
    df = frame(list(zip([1.0, 2.0, 3.0, 4.0], [10.0, 20.0, 40.0, 80.0])), "atr double, close double")
    got = [r[0] for r in df.orderBy("atr").select(I.atr_normalized("atr", "close")).collect()]
    assert np.allclose(got, [a / (c + 1e-9) * 100 for a, c in zip([1, 2, 3, 4], [10, 20, 40, 80])])


def test_missing_values_with_many_partitions(spark):
    """Half of the values missing, no coalescing of partitions: the carried mean is exact."""
    import datetime as dt
    import random

    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [("k", start + dt.timedelta(hours=i), None if rng.random() < 0.5 else (float("nan") if rng.random() < 0.05 else rng.uniform(1, 9))) for i in range(6000)]
    want, mean = {}, None
    for _, ts, x in rows:
        if x is not None and x == x:
            mean = x if mean is None else mean * 6 / 7 + x / 7
        want[ts] = mean
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.ts: r.ewm for r in I.ewm(spark.createDataFrame(rows, "token string, ts timestamp, close double").repartition(7), "close", 7).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for ts, x in want.items():
        assert (got[ts] is None) if x is None else abs(got[ts] - x) < 1e-8


def test_nan_bars_leave_later_bars_alone(spark):
    import datetime as dt
    import random

    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    bars = []
    for i in range(1000):
        low = rng.uniform(10, 20)
        bars.append(("k", start + dt.timedelta(hours=i), low, low + 2, low, low + 1.0, 1.0))
    schema = "token string, ts timestamp, open double, high double, low double, close double, volume double"
    without = {r.ts: r for r in I.indicators(spark.createDataFrame(bars[:100] + bars[101:], schema), rsi=14, atr=14, adx=14).collect()}
    nan = float("nan")
    gappy = bars[:100] + [("k", bars[100][1], nan, nan, nan, nan, nan)] + bars[101:]
    for r in I.indicators(spark.createDataFrame(gappy, schema), rsi=14, atr=14, adx=14).collect():
        if r.ts == bars[100][1]:
            assert (r.rsi, r.atr, r.adx) == (None, None, None)
        else:
            assert (r.rsi, r.atr, r.adx) == (without[r.ts].rsi, without[r.ts].atr, without[r.ts].adx)

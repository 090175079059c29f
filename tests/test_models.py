"""Labels, splits, folds, back-test, first-hit index and drift."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.config import BARRIERS
from tickloom.operators import backtest as K, dataset as D, first_hit as H, labels as L, quality
from tickloom.operators.series import POS

OHLC = "token string, s long, open double, high double, low double, close double"


def bars(frame, rows, schema=OHLC):
    df = frame(rows, schema)
    return df.withColumn("ts", F.timestamp_seconds("s")).withColumn("volume", F.lit(1.0))


def test_barriers_of_a_constant_range(frame):
    rows = [("t", 900 * i, 100.0 + i, 110.0 + i, 100.0 + i, 105.0 + i) for i in range(10)]
    for r in L.atr_barriers(bars(frame, rows)).collect():
        assert r.atr == pytest.approx(10)
        for name, (sign, multiple) in BARRIERS.items():
            assert r[name] == pytest.approx(r.close + sign * multiple * 10)


def label(frame, moves):
    rows = [("t", 0, 100.0, 100.0, 100.0, 100.0)] + [("t", 900 * (i + 1), 100.0, float(h), float(lo), 100.0) for i, (h, lo) in enumerate(moves)]
    df = bars(frame, rows).withColumns({b: F.lit(100.0 + s * m * 2) for b, (s, m) in BARRIERS.items()})
    return L.labels_given_barriers(df, {"x": 32}).orderBy("ts").first().target_x


def test_first_touch_labels(frame):
    # barriers: strong 105 / 95, plain 102.5 / 97.5, invalid 98.5 / 101.5
    assert label(frame, [(101, 99), (106, 99)]) == 2
    assert label(frame, [(103, 99), (101, 98)]) == 1
    assert label(frame, [(101, 97), (101, 99)]) == -1
    assert label(frame, [(101, 94)]) == -2
    assert label(frame, [(101, 99)] * 32) == 0
    # target and invalidation in the same bar: a tie wins nothing
    assert label(frame, [(106, 94)]) == 0


def test_split_and_weights(frame):
    rows = [("t", 1672531200 + 3600 * i) for i in range(100)]
    df = frame(rows, "token string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("target_1h", F.lit(1))
    got = D.prepared(df, "target_1h").orderBy("ts").collect()
    assert [sum(r.split == p for r in got) for p in ("train", "val", "test")] == [70, 10, 20]
    assert [r.split for r in got] == sorted((r.split for r in got), key=["train", "val", "test"].index)
    weights = [r.weight for r in got if r.split == "train"]
    assert weights == sorted(weights) and weights[-1] == pytest.approx(1.0) and got[-1].weight is None


def test_folds(frame):
    months = [dt.datetime(2020 + m // 12, m % 12 + 1, 1) for m in range(36)]
    df = frame([(m.strftime("%Y-%m-%d"),) for m in months], "d string").select(F.col("d").cast("timestamp").alias("ts"))
    folds = D.walk_forward_folds(df, 12, 3, 3).orderBy("fold").select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("train_start", "val_start", "val_end")]).collect()
    assert tuple(folds[0]) == ("2020-01-01", "2021-01-01", "2021-04-01")
    assert folds[1].train_start == "2020-04-01"
    assert max(f.val_end for f in folds) <= "2022-12-01"


def test_folds_keep_a_clipped_month_end(frame):
    df = frame([("2020-10-31",), ("2023-01-01",)], "d string").select(F.col("d").cast("timestamp").alias("ts"))
    starts = [r[0] for r in D.walk_forward_folds(df, 3, 1, 1).orderBy("fold").select(F.date_format("train_start", "yyyy-MM-dd")).collect()]
    assert starts[:6] == ["2020-10-31", "2020-11-30", "2020-12-30", "2021-01-30", "2021-02-28", "2021-03-28"]


def test_back_test_of_a_rising_market(frame):
    opens = [100 * 1.01**t for t in range(5)]
    rows = [("t", 900 * i, o, o * 1.02, o * 0.997, o * 1.01) for i, o in enumerate(opens)]
    df = bars(frame, rows)
    taken = K.select_trades(K.candidate_trades(df, df.select("token", "ts")))
    c, tp = 0.0009, 0.01
    got = K.backtest_metrics(taken, df).first()
    assert got.num_trades == 2
    assert got.total_pnl == pytest.approx(sum(opens[i] * (1 + c) * (tp - c - tp * c) for i in (1, 3)))


def simulate(rows, wants, stop, target, cost):
    """Plain bar loop of one series: (signal index, exit index or None)."""
    trades, inside, i = [], None, 0
    for i in range(len(rows) - 1):
        if inside is None:
            if wants[i]:
                entry = rows[i + 1][0] * (1 + cost)
                inside = (i, entry * (1 - stop), entry * (1 + target))
        elif rows[i][2] <= inside[1] or rows[i][1] >= inside[2]:
            trades.append((inside[0], i))
            inside = None
    if inside is not None:
        trades.append((inside[0], None))
    return trades


@pytest.mark.parametrize("fanout", [3, 128])
def test_selection_equals_the_bar_loop(frame, monkeypatch, fanout):
    monkeypatch.setattr(H, "FANOUT", fanout)
    monkeypatch.setattr(H, "TOP", 2)
    rng = np.random.default_rng(3)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, 260)))
    rows = [(float(p), float(p * 1.001), float(p * 0.999), float(p)) for p in price]
    wants = rng.random(260) < 0.3
    df = bars(frame, [("t", 900 * i, *r) for i, r in enumerate(rows)])
    signals = frame([(900 * i,) for i in np.flatnonzero(wants).tolist()], "s long").select(F.lit("t").alias("token"), F.timestamp_seconds("s").alias("ts"))
    taken = K.select_trades(K.candidate_trades(df, signals)).orderBy("signal_pos").collect()
    assert [(r.signal_pos, r.exit_pos) for r in taken] == simulate(rows, wants, 0.005, 0.01, 0.0009)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_first_hit_at_every_depth(spark, frame, monkeypatch, levels):
    monkeypatch.setattr(H, "FANOUT", 4)
    rng = np.random.default_rng(levels)
    n = 400
    low = rng.integers(50, 100, n).astype(float)
    low[rng.integers(0, n, 6)] = 10.0
    rows = frame([("t", i, float(v), float(v) + 5, i) for i, v in enumerate(low)], f"token string, {POS} long, low double, high double, s long").withColumn("ts", F.timestamp_seconds("s"))
    probes = frame([("t", int(i), float(x), None) for i in range(0, n, 7) for x in (10.0, 51.0, 5.0)], "token string, start_pos long, lower double, upper double")
    got = H.first_hit(probes, rows, levels=levels).select("start_pos", "lower", F.col("hit.at").alias("at")).collect()
    assert len(got) == 3 * len(range(0, n, 7))
    for r in got:
        later = [i for i in range(r.start_pos, n) if low[i] <= r.lower]
        assert r.at == (later[0] if later else None)


def test_promotion(frame):
    rows = [("a", "champion", 1.0), ("a", "challenger", 1.5), ("b", "champion", 1.0), ("b", "challenger", 0.8), ("c", "challenger", 0.0)]
    got = {r.token: r.promote for r in K.promotion(frame(rows, "token string, role string, sharpe double")).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_drawdown_composes_over_chunks(frame):
    rng = np.random.default_rng(5)
    pnl = rng.normal(0, 1, 300)
    df = frame([("t", 3000 * i, float(p)) for i, p in enumerate(pnl)], "token string, s long, pnl double").withColumn("exit_ts", F.timestamp_seconds("s"))
    eq = np.cumsum(pnl)
    want = (eq - np.maximum.accumulate(eq)).min()
    for chunk in (3600, 50000, 10**7):
        assert K.max_drawdown(df, chunk_seconds=chunk).first().max_drawdown == pytest.approx(want)


def test_drift_is_exact_for_any_number_of_parts(frame):
    rng = np.random.default_rng(9)
    a, b = rng.normal(0, 1, 400).round(2), rng.normal(0.5, 2, 300).round(2)
    fa, fb = (frame([(float(v),) for v in x], "f double") for x in (a, b))
    grid = np.sort(np.unique(np.r_[a, b]))
    ca, cb = (np.searchsorted(np.sort(x), grid, "right") / len(x) for x in (a, b))
    ks, w = abs(ca - cb).max(), (abs(ca - cb)[:-1] * np.diff(grid)).sum() / a.std()
    for parts in (2, 16, 64):
        got = quality.drift(fa, fb, parts=parts).first()
        assert got.ks == pytest.approx(ks) and got.wasserstein == pytest.approx(w)
    same = quality.drift_level(quality.drift(fa, fa)).first()
    assert (same.drifted, same.level) == (0, "none")


def test_sweep_scores_equal_one_backtest_for_each_set_and_fold(spark, frame):
    """Overlapping folds, a token with most rows, repeated signals, and a set without any signal."""
    rng = np.random.default_rng(5)
    rows = []
    for token, n in (("hot", 700), ("t", 240)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(token, 3600 * i, float(c * 1.001), float(c * 1.01), float(c * 0.99), float(c)) for i, c in enumerate(close)]
    b = bars(frame, rows)
    sets = frame([("a", 0.01, 0.02), ("b", 0.05, 0.1), ("none", 0.01, 0.02)], "param_id string, stop double, target double")
    picked = b.select("token", "ts", F.explode(F.expr("CASE WHEN s % 10800 = 0 THEN array('a', 'b', 'b') WHEN s % 7200 = 0 THEN array('b') ELSE array() END")).alias("param_id"))
    folds = D.walk_forward_folds(b, 5, 4, 2, "day")
    got = {(r.token, r.fold, r.param_id): r for r in K.sweep_scores(b, picked, sets, folds).collect()}
    parts = D.assign_folds(b, folds).filter("part = 'val'")
    want, wide = {}, parts.select("token", "fold").distinct().collect()
    assert set(got) == {(r.token, r.fold, s.param_id) for r in wide for s in sets.collect()}
    for s in sets.collect():
        signals = D.assign_folds(picked.filter(F.col("param_id") == s.param_id).select("token", "ts").distinct(), folds).filter("part = 'val'")
        taken = K.select_trades(K.candidate_trades(parts, signals, ["token", "fold"], s.stop, s.target), ["token", "fold"])
        want |= {(r.token, r.fold, s.param_id): r for r in K.backtest_metrics(taken, parts, ["token", "fold"]).collect()}
    assert sum(r.num_trades for r in got.values()) > 50 and {r.num_trades for k, r in got.items() if k[2] == "none"} == {0}
    for k, r in got.items():
        assert (r.num_trades, r.sharpe) == (want[k].num_trades, pytest.approx(want[k].sharpe, abs=1e-9))
    means = {r.param_id: r.mean_score for r in K.fold_mean(K.sweep_scores(b, picked, sets, folds)).collect()}
    assert means["none"] == 0.0 and means["a"] == pytest.approx(np.mean([r.sharpe for k, r in got.items() if k[2] == "a"]))

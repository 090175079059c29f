"""Registered queries: labels, splits, folds, back-test, model metrics, drift."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.config import BARRIERS, LABEL_HORIZONS
from tickloom.operators import backtest as K, dataset as D, indicators as I, labels as L, profile, quality, store
from tickloom.plans import bars_catalog as BC, features as feature_plan
from tickloom.plans.sql import ewm_view, with_views
from tickloom.session import shared_dir
from tickloom.sources import views as V
from tickloom.sources.tables import out, table

QUERIES, ORACLES = {}, {}
r = BC.r


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ------------------------------------------------------------------ labels

BARRIER_SQL = ", ".join(f"close + ({sign * multiple}) * atr AS {name}" for name, (sign, multiple) in BARRIERS.items())
LABEL_VIEWS = {
    "num": BC.NUMBERED,
    "trs": BC.TRUE_RANGE,
    "ew": ewm_view("trs", "tr", 14, "atr"),
    "bar": f"SELECT t.token, t.ts, t.i, t.high, t.low, t.close, atr, {BARRIER_SQL} FROM trs t JOIN ew USING (token, i)",
}


def _touch(b: str, above: bool) -> str:
    return f"coalesce(list_position(list_transform({'H' if above else 'W'}, lambda z: z {'>=' if above else '<='} {b}), true), 1000000) AS t_{b}"


def _label_case(n: int) -> str:
    t = {b: f"CASE WHEN t_{b} <= {n} THEN t_{b} ELSE 1000000 END" for b in BARRIERS}
    return (
        f"CASE WHEN {t['barrier_strong_bull']} < {t['barrier_bull_invalid']} THEN 2"
        f" WHEN {t['barrier_bull']} < {t['barrier_strong_bull']} AND {t['barrier_bull']} < {t['barrier_bull_invalid']} THEN 1"
        f" WHEN {t['barrier_strong_bear']} < {t['barrier_bear_invalid']} THEN -2"
        f" WHEN {t['barrier_bear']} < {t['barrier_strong_bear']} AND {t['barrier_bear']} < {t['barrier_bear_invalid']} THEN -1 ELSE 0 END"
    )


LABEL_VIEWS |= {
    "fut": """SELECT *, list(high) OVER w AS H, list(low) OVER w AS W, count(*) OVER w AS n FROM bar
        WINDOW w AS (PARTITION BY token ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 32 FOLLOWING)""",
    "tou": "SELECT *, " + ", ".join(_touch(b, b in L.ABOVE) for b in BARRIERS) + " FROM fut",
    "lab": "SELECT token, ts, " + ", ".join(f"{_label_case(n)} AS target_{h}, n >= {n} AS complete_{h}" for h, n in (("1h", 4), ("4h", 16), ("8h", 32))) + " FROM tou",
}


def labelled(extra=None):
    return with_views("bars_1h", recursive=True, extra=LABEL_VIEWS | (extra or {}))


@query(labelled() + "SELECT token, ts, round(atr, 6) AS atr, " + ", ".join(f"round({b}, 6) AS {b}" for b in BARRIERS) + " FROM bar")
def atr_barriers(spark, sf):
    return out(L.atr_barriers(V.bars_1h(spark, sf)).select("token", "ts", r("atr"), *[r(b) for b in BARRIERS]))


@query(labelled() + "SELECT token, ts, NULLIF(t_barrier_bull, 1000000)::DOUBLE AS up_steps, NULLIF(t_barrier_bear, 1000000)::DOUBLE AS down_steps FROM tou")
def first_touch(spark, sf):
    made = L.first_touch(L.atr_barriers(V.bars_1h(spark, sf)), {"barrier_bull": True, "barrier_bear": False}, 32)
    steps = [F.col(f"t_{b}").cast("double").alias(f"{n}_steps") for b, n in (("barrier_bull", "up"), ("barrier_bear", "down"))]
    return out(made.select("token", "ts", *steps))


@query(labelled() + "SELECT * FROM lab")
def barrier_labels(spark, sf):
    made = L.barrier_labels(V.bars_1h(spark, sf))
    return out(made.select("token", "ts", *[f"{c}_{h}" for h in ("1h", "4h", "8h") for c in ("target", "complete")]))


@query(
    labelled()
    + """SELECT '1h' AS horizon, target_1h AS target, count(*) AS n FROM lab GROUP BY 2
    UNION ALL SELECT '4h', target_4h, count(*) FROM lab GROUP BY 2 UNION ALL SELECT '8h', target_8h, count(*) FROM lab GROUP BY 2"""
)
def label_counts(spark, sf):
    made = L.barrier_labels(V.bars_1h(spark, sf))
    long = made.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("target")) for h in ("1h", "4h", "8h")])).alias("l"))
    return long.select("l.*").groupBy("horizon", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    labelled({"feats": "SELECT token, ts, close - open AS body, high - low AS span FROM bars_1h"})
    + "SELECT token, ts, round(body, 6) AS body, round(span, 6) AS span, target_4h FROM feats JOIN lab USING (token, ts)"
)
def features_labels(spark, sf):
    b = V.bars_1h(spark, sf)
    feats = b.select("token", "ts", (F.col("close") - F.col("open")).alias("body"), (F.col("high") - F.col("low")).alias("span"))
    made = L.barrier_labels(b).select("token", "ts", "target_4h")
    return out(feats.join(made, ["token", "ts"]).select("token", "ts", r("body"), r("span"), "target_4h"))


@query(
    BC.with_views("bars", "econ_events", recursive=True, extra={
        **BC.FT_VIEWS,
        **{k.replace("num", "lnum"): v for k, v in LABEL_VIEWS.items() if k == "num"},
        "ltrs": BC.TRUE_RANGE.replace("FROM num", "FROM lnum"),
        "ew": ewm_view("ltrs", "tr", 14, "atr"),
        "bar": LABEL_VIEWS["bar"].replace("FROM trs t", "FROM ltrs t"),
        **{k: LABEL_VIEWS[k] for k in ("fut", "tou", "lab")},
    })
    + """SELECT f.horizon, f.token, f.ts, round(f.rsi_15m, 5) AS rsi_15m, round(f.atr_normalized_1h, 5) AS atr_normalized_1h,
    CASE f.horizon WHEN '1h' THEN target_1h ELSE target_4h END AS target FROM ft_wide f JOIN lab ON lab.token = f.token AND lab.ts = f.ts WHERE """
    + " AND ".join(f"f.{c} IS NOT NULL" for c in BC.FT_NUMBERS)
)
def training_set(spark, sf):
    features = feature_plan.feature_table(V.bars(spark, sf), None, V.WINDOWS, V.HORIZON_ROLES)
    made = L.training_set(features, L.barrier_labels(V.bars_1h(spark, sf), {"1h": 4, "4h": 16}), ["1h", "4h"])
    return out(made.select("horizon", "token", "ts", r("rsi_15m", 5), r("atr_normalized_1h", 5), "target"))


@query(
    BC.with_views("bars", "econ_events", recursive=True, extra={
        **BC.ALL_VIEWS,
        **{k.replace("num", "lnum"): v for k, v in LABEL_VIEWS.items() if k == "num"},
        "ltrs": BC.TRUE_RANGE.replace("FROM num", "FROM lnum"),
        "ew": ewm_view("ltrs", "tr", 14, "atr"),
        "bar": LABEL_VIEWS["bar"].replace("FROM trs t", "FROM ltrs t"),
        **{k: LABEL_VIEWS[k] for k in ("fut", "tou", "lab")},
    })
    + """SELECT f.horizon, f.token, f.ts, round(f.rsi_15m, 5) AS rsi_15m, round(f.momentum_15m, 5) AS momentum_15m,
    CASE f.horizon WHEN '1h' THEN target_1h WHEN '4h' THEN target_4h ELSE target_8h END AS target FROM ft_wide f JOIN lab ON lab.token = f.token AND lab.ts = f.ts WHERE """
    + " AND ".join(f"f.{c} IS NOT NULL" for c in [*BC.FT_NUMBERS, *BC.OWN_WINDOWS])
)
def training_set_all(spark, sf):
    """Features and labels of all three horizons."""
    made = L.training_set(BC.all_features(spark, sf), L.barrier_labels(V.bars_1h(spark, sf), LABEL_HORIZONS), list(LABEL_HORIZONS))
    return out(made.select("horizon", "token", "ts", r("rsi_15m", 5), r("momentum_15m", 5), "target"))


# ------------------------------------------------------------------ split, weights, folds

RANKED = """SELECT *, row_number() OVER (ORDER BY ts, token) - 1 AS k, count(*) OVER () AS n FROM bars_1h"""
SPLIT_CASE = """CASE WHEN k < floor(n * (0.8::DOUBLE - 0.1::DOUBLE)) THEN 'train' WHEN k < floor(n * (0.8::DOUBLE - 0.1::DOUBLE)) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"""
WEIGHT = "0.1 + 0.9 * exp(-ln(2) / 6 * (epoch_us({top}) - epoch_us(ts)) / 1e6 / 86400 / 30.4375)"


@query(with_views("bars_1h", extra={"k": RANKED}) + f"SELECT token, ts, {SPLIT_CASE} AS split FROM k")
def chrono_split(spark, sf):
    return out(D.chrono_split(V.bars_1h(spark, sf).select("token", "ts")))


@query(
    with_views("bars_1h", extra={"k": RANKED, "s": f"SELECT ts, min(k) AS k, any_value(n) AS n FROM k GROUP BY ts", "e": "SELECT k.token, k.ts, s.k AS first_k, (SELECT count(*) FROM bars_1h b WHERE b.ts = k.ts) AS m, k.n FROM k JOIN s USING (ts)"})
    + """SELECT token, ts, CASE WHEN first_k + m <= floor(n * (0.8::DOUBLE - 0.1::DOUBLE)) THEN 'train'
    WHEN first_k + m <= floor(n * (0.8::DOUBLE - 0.1::DOUBLE)) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM e"""
)
def chrono_split_whole(spark, sf):
    return out(D.chrono_split(V.bars_1h(spark, sf).select("token", "ts"), whole_timestamps=True))


@query(with_views("bars_1h") + f"SELECT token, ts, round({WEIGHT.format(top='(SELECT max(ts) FROM bars_1h)')}, 9) AS weight FROM bars_1h")
def decay_weights(spark, sf):
    return out(D.decay_weights(V.bars_1h(spark, sf).select("token", "ts")).withColumn("weight", F.round("weight", 9)))


FOLDS_SQL = """SELECT fold, (t0 + to_days(CAST(fold * 3 AS INTEGER))) AS train_start, (t0 + to_days(CAST(fold * 3 + 14 AS INTEGER))) AS train_end,
    (t0 + to_days(CAST(fold * 3 + 14 AS INTEGER))) AS val_start, (t0 + to_days(CAST(fold * 3 + 17 AS INTEGER))) AS val_end
    FROM (SELECT min(ts) AS t0, max(ts) AS t1 FROM bars_1h), range(0, 100) g(fold) WHERE t0 + to_days(CAST(fold * 3 + 17 AS INTEGER)) <= t1"""


def _folds(spark, sf):
    return D.walk_forward_folds(V.bars_1h(spark, sf), 14, 3, 3, "day")


@query(
    """WITH RECURSIVE span AS (SELECT min(o_orderdate) AS t0, max(o_orderdate) AS t1 FROM orders),
    s AS (SELECT 0 AS fold, t0 AS a, t1 FROM span UNION ALL SELECT fold + 1, a + INTERVAL 3 MONTH, t1 FROM s WHERE a < t1)
    SELECT fold, a AS train_start, a + INTERVAL 12 MONTH AS train_end, a + INTERVAL 12 MONTH AS val_start, a + INTERVAL 12 MONTH + INTERVAL 3 MONTH AS val_end
    FROM s WHERE a + INTERVAL 12 MONTH + INTERVAL 3 MONTH <= t1 AND a < t1"""
)
def wfo_folds(spark, sf):
    return out(D.walk_forward_folds(table(spark, sf, "orders"), 12, 3, 3, "month", "o_orderdate"))


@query(
    with_views("bars_1h", extra={"folds": FOLDS_SQL})
    + """SELECT token, ts, fold::INTEGER AS fold, CASE WHEN ts < train_end THEN 'train' ELSE 'val' END AS part FROM bars_1h JOIN folds ON ts >= train_start AND ts < val_end"""
)
def walk_forward_assign(spark, sf):
    return out(D.assign_folds(V.bars_1h(spark, sf).select("token", "ts"), _folds(spark, sf)))


@query(
    labelled({"folds": FOLDS_SQL, "kk": "SELECT *, row_number() OVER (ORDER BY ts, token) - 1 AS k, count(*) OVER () AS n FROM lab WHERE complete_4h",
              "sp": f"SELECT *, {SPLIT_CASE} AS split FROM kk"})
    + f"""SELECT token, ts, target_4h, split, CASE WHEN split = 'train' THEN round({WEIGHT.format(top="(SELECT max(ts) FROM sp WHERE split = 'train')")}, 9) END AS weight,
    fold::INTEGER AS fold, CASE WHEN ts < train_end THEN 'train' ELSE 'val' END AS part FROM sp JOIN folds ON ts >= train_start AND ts < val_end"""
)
def prepared(spark, sf):
    made = L.barrier_labels(V.bars_1h(spark, sf), {"4h": 16}).filter("complete_4h").select("token", "ts", "target_4h")
    return out(D.prepared(made, "target_4h", _folds(spark, sf)).withColumn("weight", F.round("weight", 9)))


# ------------------------------------------------------------------ back-test

ENTRY = f"(1.0::DOUBLE + 0.0005::DOUBLE + 0.0004::DOUBLE)"
BT_VIEWS = {
    "px": """SELECT *, row_number() OVER w - 1 AS i, lead(open) OVER w AS next_open, lead(ts) OVER w AS entry_ts, count(*) OVER (PARTITION BY token) AS n
        FROM bars_1h WINDOW w AS (PARTITION BY token ORDER BY ts)""",
    "sig": f"""SELECT m.model, px.token, px.ts AS signal_ts, px.i, px.entry_ts, next_open * {ENTRY} AS e, n FROM px, (VALUES ('model_a'), ('model_b')) m(model)
        WHERE next_open IS NOT NULL AND CASE WHEN m.model = 'model_a' THEN close > open ELSE close < open END""",
    "hit": """SELECT s.model, s.token, s.i, min(p.i) AS xi FROM sig s JOIN px p ON p.token = s.token AND p.i > s.i AND p.i < s.n - 1
        AND (p.low <= s.e * (1 - 0.005::DOUBLE) OR p.high >= s.e * (1 + 0.01::DOUBLE)) GROUP BY 1, 2, 3""",
    "cand": """SELECT s.model, s.token, s.signal_ts, s.i AS signal_pos, s.entry_ts, s.e AS entry_price, coalesce(x.ts, l.ts) AS exit_ts, h.xi AS exit_pos,
        CASE WHEN x.ts IS NULL THEN l.close WHEN x.low <= s.e * (1 - 0.005::DOUBLE) THEN s.e * (1 - 0.005::DOUBLE) ELSE s.e * (1 + 0.01::DOUBLE) END * (1 - 0.0009::DOUBLE) AS exit_price,
        CASE WHEN x.ts IS NULL THEN 'LAST_CLOSE' WHEN x.low <= s.e * (1 - 0.005::DOUBLE) THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS exit_reason
        FROM sig s LEFT JOIN hit h USING (model, token, i) LEFT JOIN px x ON x.token = s.token AND x.i = h.xi JOIN px l ON l.token = s.token AND l.i = l.n - 1""",
    "chain": """SELECT model, token, min(signal_pos) AS signal_pos FROM cand GROUP BY 1, 2
        UNION ALL SELECT c.model, c.token, (SELECT min(d.signal_pos) FROM cand d WHERE d.model = c.model AND d.token = c.token AND d.signal_pos > k.exit_pos)
        FROM chain c JOIN cand k USING (model, token, signal_pos) WHERE k.exit_pos IS NOT NULL AND EXISTS
        (SELECT 1 FROM cand d WHERE d.model = c.model AND d.token = c.token AND d.signal_pos > k.exit_pos)""",
    "taken": "SELECT cand.*, exit_price - entry_price AS pnl, (exit_price - entry_price) / entry_price AS ret FROM cand JOIN chain USING (model, token, signal_pos)",
}
MDD = """eq AS (SELECT model, token, sum(pnl) OVER (PARTITION BY model, token ORDER BY exit_ts ROWS UNBOUNDED PRECEDING) AS eq, exit_ts FROM taken),
    dd AS (SELECT model, token, eq - max(eq) OVER (PARTITION BY model, token ORDER BY exit_ts ROWS UNBOUNDED PRECEDING) AS d FROM eq)"""
SHARPE_VIEWS = {
    "rets": """SELECT m.model, b.token, b.ts, coalesce(t.ret, 0) AS x FROM bars_1h b CROSS JOIN (VALUES ('model_a'), ('model_b')) m(model)
        LEFT JOIN taken t ON t.model = m.model AND t.token = b.token AND t.exit_ts = b.ts""",
    "shp": """SELECT model, token, CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(35040) ELSE 0 END AS sharpe FROM rets GROUP BY 1, 2""",
}
MDD_VIEWS = {
    "eq": "SELECT model, token, exit_ts, sum(pnl) OVER (PARTITION BY model, token ORDER BY exit_ts ROWS UNBOUNDED PRECEDING) AS eq FROM taken",
    "dd": "SELECT model, token, eq - max(eq) OVER (PARTITION BY model, token ORDER BY exit_ts ROWS UNBOUNDED PRECEDING) AS d FROM eq",
}


def bt(body: str, *more: dict) -> str:
    extra = dict(BT_VIEWS)
    for m in more:
        extra |= m
    return with_views("bars_1h", recursive=True, extra=extra) + body


def _bars_by_model(spark, sf):
    return V.bars_1h(spark, sf).withColumn("model", F.explode(F.array(F.lit("model_a"), F.lit("model_b"))))


def _candidates(spark, sf):
    b = _bars_by_model(spark, sf)
    rise, fall = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    signals = b.filter((F.col("model") == "model_a") & rise | (F.col("model") == "model_b") & fall).select("model", "token", "ts")
    return K.candidate_trades(b, signals, ["model", "token"])


@query(bt("SELECT model, token, signal_ts, signal_pos, entry_ts, round(entry_price, 6) AS entry_price, exit_ts, exit_pos::DOUBLE AS exit_pos, round(exit_price, 6) AS exit_price, exit_reason FROM cand"))
def candidate_trades(spark, sf):
    return out(_candidates(spark, sf).withColumns({"entry_price": F.round("entry_price", 6), "exit_price": F.round("exit_price", 6), "exit_pos": F.col("exit_pos").cast("double")}).drop("pnl", "ret"))


@query(bt("SELECT model, token, signal_ts, signal_pos, entry_ts, exit_ts, round(pnl, 6) AS pnl, round(ret, 8) AS ret, exit_reason FROM taken"))
def select_trades(spark, sf):
    taken = K.select_trades(_candidates(spark, sf), ["model", "token"])
    return out(taken.select("model", "token", "signal_ts", "signal_pos", "entry_ts", "exit_ts", r("pnl"), r("ret", 8), "exit_reason"))


@query(
    bt(
        """SELECT shp.model, shp.token, round(sharpe, 6) AS sharpe, round(total_pnl, 6) AS total_pnl, num_trades, round(max_drawdown, 6) AS max_drawdown FROM shp
        JOIN (SELECT model, token, sum(pnl) AS total_pnl, count(*) AS num_trades FROM taken GROUP BY 1, 2) USING (model, token)
        JOIN (SELECT model, token, min(d) AS max_drawdown FROM dd GROUP BY 1, 2) USING (model, token)""",
        SHARPE_VIEWS,
        MDD_VIEWS,
    )
)
def backtest_metrics(spark, sf):
    keys = ["model", "token"]
    taken = K.select_trades(_candidates(spark, sf), keys)
    made = K.backtest_metrics(taken, _bars_by_model(spark, sf), keys)
    return made.select(*keys, r("sharpe"), r("total_pnl"), "num_trades", r("max_drawdown"))


@query(
    bt(
        """SELECT token, round(a, 6) AS challenger_sharpe, round(b, 6) AS champion_sharpe, a >= 1.1 * b AS promote FROM
        (SELECT token, max(sharpe) FILTER (WHERE model = 'model_a') AS a, max(sharpe) FILTER (WHERE model = 'model_b') AS b FROM shp GROUP BY 1)""",
        SHARPE_VIEWS,
    )
)
def promotion(spark, sf):
    keys = ["model", "token"]
    taken = K.select_trades(_candidates(spark, sf), keys)
    scores = K.sharpe(taken, _bars_by_model(spark, sf), keys)
    roles = scores.withColumn("role", F.when(F.col("model") == "model_a", "challenger").otherwise("champion"))
    return K.promotion(roles).select("token", r("challenger_sharpe"), r("champion_sharpe"), "promote")


# parameter sets: window of the strength index, level that opens a trade, stop and target
SETS = [("a", 14, 55.5, 0.005, 0.01), ("b", 5, 62.5, 0.02, 0.05), ("c", 21, 45.5, 0.01, 0.3), ("d", 9, 101.5, 0.01, 0.02)]
SWEEP_VIEWS = {
    "sets": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}, {at}::DOUBLE, {s}::DOUBLE, {t}::DOUBLE)" for p, n, at, s, t in SETS) + ") v(param_id, nr, level, stop, target)",
    "src": "SELECT token, param_id AS grp, nr, 14 AS na, 14 AS nd, ts, open, high, low, close, volume, param_id FROM bars_1h CROSS JOIN sets",
    **BC.indicator_views("src"),
    "folds": FOLDS_SQL,
    "px": """SELECT token, fold, ts, open, high, low, close, row_number() OVER w - 1 AS i, lead(open) OVER w AS next_open, lead(ts) OVER w AS entry_ts,
        count(*) OVER (PARTITION BY token, fold) AS n FROM bars_1h JOIN folds ON ts >= val_start AND ts < val_end WINDOW w AS (PARTITION BY token, fold ORDER BY ts)""",
    "sig": f"""SELECT param_id, token, fold, i, next_open * {ENTRY} AS e, stop, target, n FROM px JOIN (SELECT token, ts, param_id, rsi FROM ind) USING (token, ts)
        JOIN sets USING (param_id) WHERE next_open IS NOT NULL AND rsi > level""",
    "hit": """SELECT s.param_id, s.token, s.fold, s.i, min(p.i) AS xi FROM sig s JOIN px p ON p.token = s.token AND p.fold = s.fold AND p.i > s.i AND p.i < s.n - 1
        AND (p.low <= s.e * (1 - stop) OR p.high >= s.e * (1 + target)) GROUP BY 1, 2, 3, 4""",
    "cand": """SELECT s.param_id, s.token, s.fold, s.i, h.xi, coalesce(x.ts, l.ts) AS exit_ts,
        (CASE WHEN x.ts IS NULL THEN l.close WHEN x.low <= s.e * (1 - stop) THEN s.e * (1 - stop) ELSE s.e * (1 + target) END * (1 - 0.0009::DOUBLE) - s.e) / s.e AS ret
        FROM sig s LEFT JOIN hit h USING (param_id, token, fold, i) LEFT JOIN px x ON x.token = s.token AND x.fold = s.fold AND x.i = h.xi
        JOIN px l ON l.token = s.token AND l.fold = s.fold AND l.i = l.n - 1""",
    "chain": """SELECT param_id, token, fold, min(i) AS i FROM cand GROUP BY 1, 2, 3
        UNION ALL SELECT * FROM (SELECT c.param_id, c.token, c.fold, (SELECT min(d.i) FROM cand d WHERE d.param_id = c.param_id AND d.token = c.token AND d.fold = c.fold AND d.i > k.xi) AS i
        FROM chain c JOIN cand k USING (param_id, token, fold, i) WHERE k.xi IS NOT NULL) WHERE i IS NOT NULL""",
    "gain": "SELECT param_id, token, fold, exit_ts AS ts, sum(ret) AS x, count(*) AS n_trades FROM cand JOIN chain USING (param_id, token, fold, i) GROUP BY 1, 2, 3, 4",
    "scores": """SELECT param_id, token, fold, sum(coalesce(n_trades, 0))::BIGINT AS num_trades,
        coalesce(avg(coalesce(x, 0)) / nullif(stddev_samp(coalesce(x, 0)), 0) * sqrt(35040), 0) AS sharpe
        FROM px CROSS JOIN sets LEFT JOIN gain USING (param_id, token, fold, ts) GROUP BY 1, 2, 3""",
}


def _sweep_scores(spark, sf):
    sets = spark.createDataFrame(SETS, "param_id string, window int, level double, stop double, target double")
    swept = I.sweep(V.bars_1h(spark, sf).withColumn("tf", F.lit("1h")), [{"param_id": p, "tf": "1h", "rsi": n} for p, n, *_ in SETS])
    level = F.element_at(F.create_map(*[F.lit(x) for p, _, at, *_ in SETS for x in (p, at)]), F.col("param_id"))
    return K.sweep_scores(V.bars_1h(spark, sf), swept.filter(F.col("rsi") > level), sets, _folds(spark, sf))


@query(with_views("bars_1h", recursive=True, extra=SWEEP_VIEWS) + "SELECT param_id, token, fold::INTEGER AS fold, num_trades, round(sharpe, 6) AS sharpe FROM scores")
def sweep_fold_scores(spark, sf):
    return _sweep_scores(spark, sf).select("param_id", "token", "fold", "num_trades", r("sharpe"))


@query(with_views("bars_1h", recursive=True, extra=SWEEP_VIEWS) + "SELECT param_id, round(avg(sharpe), 6) AS mean_score FROM scores GROUP BY 1")
def sweep_evaluation(spark, sf):
    return K.fold_mean(_sweep_scores(spark, sf)).select("param_id", r("mean_score"))


CLOSED_SQL = with_views("closed")


def closed(spark, sf):
    from tickloom.operators import trades as T

    t = V.trades(spark, sf).filter(F.col("exit_ts").isNotNull())
    return t.withColumn("pnl_usd", T.realised_pnl(*(F.col(c) for c in ("direction", "entry_price", "exit_price", "position_size", "fees"))))


@query(
    CLOSED_SQL
    + """, e AS (SELECT token, trade_id, exit_ts, sum(pnl_usd) OVER (PARTITION BY token ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS eq FROM closed),
    d AS (SELECT token, eq - max(eq) OVER (PARTITION BY token ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS d FROM e)
    SELECT token, round(min(d), 3) AS max_drawdown FROM d GROUP BY token"""
)
def max_drawdown(spark, sf):
    made = K.max_drawdown(closed(spark, sf), "pnl_usd", ["token"], "exit_ts", ["trade_id"])
    return made.select("token", r("max_drawdown", 3))


@query(
    with_views("bars_1h", "closed")
    + """, t AS (SELECT CASE token WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'error' END AS token,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (trade_no % 720) AS ts, pnl_usd / (entry_price * position_size) AS x FROM closed),
    b AS (SELECT token, ts, coalesce(sum(x), 0) AS x FROM bars_1h LEFT JOIN t USING (token, ts) GROUP BY 1, 2)
    SELECT token, round(coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(35040), 0), 6) AS sharpe FROM b GROUP BY 1"""
)
def sharpe(spark, sf):
    """Returns of closed trades spread over the hours of the bars: several exits fall on one bar."""
    hour = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + 3600 * (F.col("trade_no") % 720))
    c = closed(spark, sf).select(
        F.when(F.col("token") == "A", "click").when(F.col("token") == "N", "view").otherwise("error").alias("token"),
        hour.alias("exit_ts"),
        (F.col("pnl_usd") / (F.col("entry_price") * F.col("position_size"))).alias("ret"),
    )
    bars = V.bars_1h(spark, sf)
    exits = c.join(bars.select("token", F.col("ts").alias("exit_ts")), ["token", "exit_ts"], "left_semi")
    return K.sharpe(exits, bars).select("token", r("sharpe"))


@query(
    """SELECT ts_::VARCHAR AS param_id, round(avg(coalesce(score, 0)), 6) AS mean_score FROM (SELECT o_orderstatus AS ts_, o_custkey % 12 AS fold,
    CASE WHEN o_custkey % 12 < 10 THEN avg(o_totalprice) END AS score FROM orders GROUP BY 1, 2) GROUP BY 1"""
)
def fold_mean(spark, sf):
    o = table(spark, sf, "orders")
    fold = F.col("o_custkey") % 12
    scores = o.groupBy(F.col("o_orderstatus").alias("param_id"), fold.alias("fold")).agg(F.when(F.first(fold) < 10, F.avg("o_totalprice")).alias("sharpe"))
    return K.fold_mean(scores).select("param_id", r("mean_score"))


@query(
    with_views("bars_1h")
    + """, p AS (SELECT token, ts, unnest([sign(close - open), CASE WHEN volume > 2 THEN sign(high - close - (close - low)) END, sign(volume - 3)]) AS pred FROM bars_1h)
    SELECT token, ts, round(avg(pred), 6) AS mean_pred, CASE WHEN avg(pred) > 0 THEN 'OPEN_LONG' ELSE 'FLAT' END AS directive FROM p GROUP BY 1, 2"""
)
def mean_prediction(spark, sf):
    b = V.bars_1h(spark, sf)
    three = F.array(
        F.signum(F.col("close") - F.col("open")),
        F.when(F.col("volume") > 2, F.signum(F.col("high") - F.col("close") - (F.col("close") - F.col("low")))),
        F.signum(F.col("volume") - 3),
    )
    return out(K.mean_prediction(b.select("token", "ts", F.explode(three).alias("pred"))).withColumn("mean_pred", F.round("mean_pred", 6)))


# ------------------------------------------------------------------ model metrics and drift


@query(
    """WITH s AS (SELECT o_orderstatus AS grp, o_orderkey % 3 AS y, o_custkey % 3 AS pred, (1 + o_orderkey % 5)::DOUBLE AS a, (1 + o_custkey % 7)::DOUBLE AS b, 2.0::DOUBLE AS c FROM orders),
    p AS (SELECT *, CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c) AS py FROM s),
    f AS (SELECT grp, g.k, count(*) FILTER (WHERE y = k AND pred = k) AS tp, count(*) FILTER (WHERE y = k) + count(*) FILTER (WHERE pred = k) AS yp FROM p, range(0, 3) g(k) GROUP BY 1, 2)
    SELECT grp, round(any_value(m.log_loss), 6) AS log_loss, round(any_value(m.accuracy), 6) AS accuracy, round(avg(2.0::DOUBLE * tp / yp), 6) AS macro_f1
    FROM f JOIN (SELECT grp, avg(-ln(py)) AS log_loss, avg((y = pred)::INT) AS accuracy FROM p GROUP BY 1) m USING (grp) WHERE yp > 0 GROUP BY grp"""
)
def class_metrics(spark, sf):
    o = table(spark, sf, "orders")
    a, b, c = 1 + F.col("o_orderkey") % 5, 1 + F.col("o_custkey") % 7, F.lit(2)
    total = (a + b + c).cast("double")
    scored = o.select(
        F.col("o_orderstatus").alias("grp"),
        (F.col("o_orderkey") % 3).cast("int").alias("y"),
        (F.col("o_custkey") % 3).cast("int").alias("pred"),
        F.create_map(F.lit(0), a / total, F.lit(1), b / total, F.lit(2), c / total).alias("probas"),
    )
    return D.class_metrics(scored, [0, 1, 2], ["grp"]).select("grp", r("log_loss"), r("accuracy"), r("macro_f1"))


DRIFT_SQL = """, long AS (SELECT unnest(['close', 'volume', 'span']) AS feature, unnest([close, volume, high - low]) AS v, ts < TIMESTAMP '2024-01-16' AS ref FROM bars_1h),
    d AS (SELECT feature, v, count(*) FILTER (WHERE ref) AS nr, count(*) FILTER (WHERE NOT ref) AS nc FROM long GROUP BY 1, 2),
    c AS (SELECT feature, v, sum(nr) OVER w / sum(nr) OVER (PARTITION BY feature) AS fr, sum(nc) OVER w / sum(nc) OVER (PARTITION BY feature) AS fc,
        lead(v) OVER (PARTITION BY feature ORDER BY v) AS nv FROM d WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT feature, greatest(stddev_pop(v) FILTER (WHERE ref), 0.001) AS sc FROM long GROUP BY 1),
    st AS (SELECT feature, max(abs(fr - fc)) AS ks, sum(abs(fr - fc) * coalesce(nv - v, 0)) / any_value(sc) AS wasserstein FROM c JOIN s USING (feature) GROUP BY 1)
    """


def _drift(spark, sf):
    b = V.bars_1h(spark, sf).withColumn("span", F.col("high") - F.col("low"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    return quality.drift(b.filter(early), b.filter(~early), ["close", "volume", "span"], threshold=0.05)


@query(with_views("bars_1h") + DRIFT_SQL + "SELECT feature, round(ks, 6) AS ks, round(wasserstein, 6) AS wasserstein, wasserstein >= 0.05 AS drifted FROM st")
def drift_features(spark, sf):
    return _drift(spark, sf).select("feature", r("ks"), r("wasserstein"), "drifted")


@query(
    with_views("bars_1h")
    + DRIFT_SQL
    + """SELECT count(*) AS features, count(*) FILTER (WHERE wasserstein >= 0.05) AS drifted, round(avg((wasserstein >= 0.05)::INT), 6) AS share,
    CASE WHEN avg((wasserstein >= 0.05)::INT) >= 0.6 THEN 'severe' WHEN avg((wasserstein >= 0.05)::INT) >= 0.3 THEN 'moderate' ELSE 'none' END AS level FROM st"""
)
def drift_share(spark, sf):
    return quality.drift_level(_drift(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    with_views("bars_1h", "ticks", "signals")
    + """, u AS (SELECT 'bars' AS dataset, max(ts) AS t FROM bars_1h UNION ALL SELECT 'ticks', max(ts) FROM ticks
    UNION ALL SELECT 'signals', max(ts) FROM signals UNION ALL SELECT 'open', NULL)
    SELECT dataset, t AS newest_ts, round((epoch_us(TIMESTAMP '2024-01-31 00:10:00') - epoch_us(t)) / 1e6, 3) AS age_seconds,
    CASE WHEN t IS NULL THEN 'no data' WHEN (epoch_us(TIMESTAMP '2024-01-31 00:10:00') - epoch_us(t)) / 1e6 > 1800 THEN 'stale' ELSE 'fresh' END AS status FROM u"""
)
def freshness(spark, sf):
    sets = {"bars": V.bars_1h(spark, sf), "ticks": V.ticks(spark, sf), "signals": V.signals(spark, sf)}
    stacked = None
    for name, df in sets.items():
        one = df.select(F.lit(name).alias("dataset"), "ts")
        stacked = one if stacked is None else stacked.unionByName(one)
    empty = V.trades(spark, sf).filter(F.col("exit_ts").isNull()).select(F.lit("open").alias("dataset"), F.col("exit_ts").alias("ts"))
    made = quality.freshness(stacked.unionByName(empty), F.lit("2024-01-31 00:10:00").cast("timestamp"))
    return out(made.withColumn("age_seconds", F.round("age_seconds", 3)))


@query(
    with_views("bars_1h", "ticks", "signals")
    + """SELECT 'bars' AS dataset, count(*) AS rows, 7 AS columns FROM bars_1h UNION ALL SELECT 'ticks', count(*), 5 FROM ticks UNION ALL SELECT 'signals', count(*), 7 FROM signals"""
)
def dataset_profile(spark, sf):
    return store.dataset_profile({"bars": V.bars_1h(spark, sf), "ticks": V.ticks(spark, sf), "signals": V.signals(spark, sf)}).drop("names")


PROFILED = {"ret": "(close - open) / open", "span": "high - low", "volume": "CASE WHEN hour(ts) <> 5 THEN volume END", "level": "close"}
_CELLS = " UNION ALL ".join(f"SELECT '{n}' AS feature, {e} AS x, day(ts) AS d FROM bars_1h" for n, e in PROFILED.items())


@query(
    with_views("bars_1h")
    + f""", x AS ({_CELLS}), c AS (SELECT feature, CASE WHEN x IS NOT NULL THEN floor(sign(x) * ln(abs(x) + sqrt(x * x + 1)) * 16)::BIGINT END AS cell,
    count(*) FILTER (d < 16) AS a, count(*) FILTER (d >= 16) AS b FROM x GROUP BY 1, 2),
    r AS (SELECT feature, cell, least(greatest(floor(sqrt(count(*) OVER e)), 2), 20)::INTEGER AS parts, coalesce(sum(a) OVER (e ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(a) OVER e AS whole FROM c WHERE cell IS NOT NULL AND a > 0 WINDOW e AS (PARTITION BY feature)),
    p AS (SELECT feature, cell, parts, (before * parts // whole)::INTEGER AS part FROM r),
    j AS (SELECT c.*, p.parts, CASE WHEN c.cell IS NULL THEN -1 ELSE coalesce((SELECT arg_max(part, y.cell) FROM p y WHERE y.feature = c.feature AND y.cell <= c.cell), 0) END AS part
    FROM c LEFT JOIN p ON p.feature = c.feature AND p.cell = c.cell),
    g AS (SELECT feature, part, sum(a) AS a, sum(b) AS b, max(parts) AS parts FROM j GROUP BY 1, 2),
    s AS (SELECT *, (a + 0.5) / (sum(a) OVER e + 0.5 * count(*) OVER e) AS p, (b + 0.5) / (sum(b) OVER e + 0.5 * count(*) OVER e) AS q FROM g WINDOW e AS (PARTITION BY feature))
    SELECT feature, max(parts)::INTEGER AS parts, sum(a)::BIGINT AS n_reference, sum(b)::BIGINT AS n_current, coalesce(sum(a) FILTER (part = -1), 0)::BIGINT AS missing_reference,
    coalesce(sum(b) FILTER (part = -1), 0)::BIGINT AS missing_current, round(sum((q - p) * ln(q / p)), 6) AS psi FROM s GROUP BY 1"""
)
def drift_profile(spark, sf):
    """The second half of the month against the profile stored by two runs over the first."""
    folder = f"{shared_dir(spark)}/profile-{uuid.uuid4().hex}"
    rows = V.bars_1h(spark, sf).select(F.dayofmonth("ts").alias("d"), *[F.expr(e).alias(n) for n, e in PROFILED.items()])
    for run, chosen in (("a", "d < 9"), ("b", "d >= 9 AND d < 16")):
        profile.store_profile(profile.profile(rows.filter(chosen), list(PROFILED)), folder, run)
    made = profile.drift(profile.stored_profile(spark, folder), profile.profile(rows.filter("d >= 16"), list(PROFILED)))
    return made.withColumn("psi", F.round("psi", 6))

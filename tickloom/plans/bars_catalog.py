"""Registered queries: scans, bars, coverage, indicators, time features, as-of joins, feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.config import FEATURES
from tickloom.functions import temporal, timeparse
from tickloom.operators import asof, bars as B, indicators as I, series, store
from tickloom.operators.registry import Feature, settings_of, standard_features
from tickloom.plans import features as feature_plan
from tickloom.plans.sql import BAR_AGG, ewm_view, indicator_views, with_views
from tickloom.sources import views as V
from tickloom.sources.tables import out, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


OHLCV = "open, high, low, close, volume"

# ------------------------------------------------------------------ scans and retention


@query(
    with_views("bars")
    + """SELECT * FROM bars WHERE tf IN ('1h', '4h') AND token IN ('click', 'view', 'error')
    AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""
)
def scan_bars(spark, sf):
    return out(store.scan_bars(V.bars(spark, sf), ["click", "view", "error"], ["1h", "4h"], "2024-01-05 00:00:00", "2024-01-20 12:00:00"))


@query(with_views("bars") + "SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY token, tf ORDER BY ts DESC) <= 200")
def latest_n(spark, sf):
    return out(B.latest_n(V.bars(spark, sf), 200))


@query(
    with_views("bars")
    + """SELECT token, tf, ts, open, high, low, close, volume, batch FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS batch FROM bars)
    QUALIFY row_number() OVER (PARTITION BY token, tf ORDER BY batch DESC, ts DESC) <= 50"""
)
def rolling_retention(spark, sf):
    b = V.bars(spark, sf)
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    stored, incoming = b.filter(~late).withColumn("batch", F.lit(0)), b.filter(late).withColumn("batch", F.lit(1))
    return out(store.rolling_retention(stored, incoming, 50, ["token", "tf"], ["batch", "ts"]))


@query(with_views("bars") + "SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 20 DAY")
def prune_window(spark, sf):
    return out(store.prune_window(V.bars(spark, sf), F.lit("2024-02-05 00:00:00").cast("timestamp"), 20))


@query(
    with_views("bars_1h")
    + f"""SELECT token, ts, {OHLCV} FROM bars_1h QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts DESC) > 1"""
)
def drop_incomplete(spark, sf):
    return out(B.drop_incomplete(V.bars_1h(spark, sf), 3600))


@query(
    with_views("bars_1h")
    + f"""SELECT token, ts, {OHLCV}, seq FROM (SELECT *, 1 AS seq FROM bars_1h UNION ALL SELECT token, ts, open, high, low, close, volume + 1, 2 FROM bars_1h WHERE volume > 1)
    QUALIFY row_number() OVER (PARTITION BY token, ts ORDER BY seq DESC) = 1"""
)
def dedupe_last(spark, sf):
    b = V.bars_1h(spark, sf)
    again = b.filter("volume > 1").withColumn("volume", F.col("volume") + 1).withColumn("seq", F.lit(2))
    return out(B.dedupe_last(b.withColumn("seq", F.lit(1)).unionByName(again)))


# ------------------------------------------------------------------ bars


@query(with_views("ticks") + """SELECT token, time_bucket(INTERVAL '1 minute', ts) AS ts, arg_min(price, tick_id) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, tick_id) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2""")
def ticks_to_bars(spark, sf):
    return out(B.ticks_to_bars(V.ticks(spark, sf), 60))


@query(with_views("bars") + "SELECT * FROM bars")
def resample_bars(spark, sf):
    return out(V.bars(spark, sf))


@query(with_views("bars") + "SELECT token, tf, min(ts) AS min_ts, max(ts) AS max_ts FROM bars GROUP BY 1, 2")
def coverage(spark, sf):
    return out(B.coverage(V.bars(spark, sf)))


@query(
    with_views("bars")
    + """, have AS (SELECT token, tf, min(ts) AS a, max(ts) AS b FROM bars WHERE token <> 'view' GROUP BY 1, 2),
    want AS (SELECT DISTINCT token, tf, CASE tf WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 WHEN '1d' THEN 86400 ELSE 604800 END AS step FROM bars),
    j AS (SELECT * FROM want LEFT JOIN have USING (token, tf))
    SELECT token, tf, 'all' AS kind, TIMESTAMP '2023-12-20' AS gap_start, TIMESTAMP '2024-02-10' AS gap_end FROM j WHERE a IS NULL
    UNION ALL SELECT token, tf, 'head', TIMESTAMP '2023-12-20', greatest(TIMESTAMP '2023-12-20', a - to_seconds(step)) FROM j WHERE a > TIMESTAMP '2023-12-20'
    UNION ALL SELECT token, tf, 'tail', least(TIMESTAMP '2024-02-10', b + to_seconds(step)), TIMESTAMP '2024-02-10' FROM j WHERE b < TIMESTAMP '2024-02-10'"""
)
def coverage_gaps(spark, sf):
    b = V.bars(spark, sf)
    expected = b.select("token", "tf").distinct()
    have = B.coverage(b.filter("token <> 'view'"))
    step = F.expr("CASE tf WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 WHEN '1d' THEN 86400 ELSE 604800 END")
    bound = lambda t: F.lit(t).cast("timestamp")
    return out(B.coverage_gaps(have, expected, step, bound("2023-12-20"), bound("2024-02-10")))


@query(
    with_views("bars_1h")
    + """, span AS (SELECT token, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars_1h GROUP BY token),
    miss AS (SELECT span.token, span.ts FROM span ANTI JOIN bars_1h USING (token, ts)),
    isl AS (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY token ORDER BY ts)) AS g FROM miss)
    SELECT token, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS missing FROM isl GROUP BY token, g"""
)
def bar_gaps(spark, sf):
    return out(B.bar_gaps(V.bars_1h(spark, sf), 3600))


@query(with_views("ticks") + "SELECT token, ts, (floor(epoch(ts) / 60)::BIGINT % 15) = 0 AS on_15m, (floor(epoch(ts) / 60)::BIGINT % 60) = 0 AS on_1h FROM ticks")
def tf_boundary(spark, sf):
    return out(V.ticks(spark, sf).select("token", "ts", timeparse.on_boundary("ts", 15).alias("on_15m"), timeparse.on_boundary("ts", 60).alias("on_1h")))


# ------------------------------------------------------------------ indicators

NUMBERED = "SELECT *, row_number() OVER (PARTITION BY token ORDER BY ts) - 1 AS i, lag(close) OVER (PARTITION BY token ORDER BY ts) AS pc FROM bars_1h"
TRUE_RANGE = "SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM num"
ONE = lambda nr, na, nd: f"SELECT token, 'x' AS grp, {nr} AS nr, {na} AS na, {nd} AS nd, ts, open, high, low, close, volume FROM bars_1h"


def single(nr, na, nd):
    return with_views("bars_1h", recursive=True, extra={"src": ONE(nr, na, nd), **indicator_views("src")})


@query(
    with_views("bars_1h", recursive=True, extra={"num": NUMBERED, "ew": ewm_view("num", "close", 14)})
    + "SELECT num.token, num.ts, CASE WHEN num.i >= 13 THEN round(ewm, 6) END AS ewm FROM num JOIN ew USING (token, i)"
)
def ewm_wilder(spark, sf):
    return out(I.ewm(V.bars_1h(spark, sf), "close", 14, min_periods=14).select("token", "ts", r("ewm")))


# bars with missing and NaN prices; the sequential twins walk over the whole ones
GAPPY = """SELECT token, ts, open, CASE WHEN hour(ts) % 7 = 3 THEN NULL WHEN hour(ts) % 11 = 5 THEN 'NaN'::DOUBLE ELSE high END AS high, low,
    CASE WHEN (epoch(ts) // 3600)::BIGINT % 5 < 2 THEN NULL WHEN hour(ts) % 13 = 4 THEN 'NaN'::DOUBLE ELSE close END AS close, volume FROM bars_1h"""
WHOLE = "high IS NOT NULL AND NOT isnan(high) AND close IS NOT NULL AND NOT isnan(close)"


def bars_with_gaps(spark, sf):
    b, nan = V.bars_1h(spark, sf), F.lit(float("nan"))
    hour = F.hour("ts")
    high = F.when(hour % 7 == 3, None).when(hour % 11 == 5, nan).otherwise(F.col("high"))
    close = F.when(F.floor(F.unix_seconds("ts") / 3600) % 5 < 2, None).when(hour % 13 == 4, nan).otherwise(F.col("close"))
    return b.withColumns({"high": high, "close": close})


@query(
    with_views("bars_1h", recursive=True, extra={
        "gappy": GAPPY,
        "num": "SELECT *, row_number() OVER (PARTITION BY token ORDER BY ts) - 1 AS i FROM gappy WHERE close IS NOT NULL AND NOT isnan(close)",
        "ew": ewm_view("num", "close", 14),
        "placed": "SELECT gappy.token, gappy.ts, num.i, ewm FROM gappy LEFT JOIN num USING (token, ts) LEFT JOIN ew ON ew.token = num.token AND ew.i = num.i",
    })
    + """, f AS (SELECT token, ts, last_value(i IGNORE NULLS) OVER w AS i, last_value(ewm IGNORE NULLS) OVER w AS ewm FROM placed
    WINDOW w AS (PARTITION BY token ORDER BY ts ROWS UNBOUNDED PRECEDING)) SELECT token, ts, CASE WHEN i >= 4 THEN round(ewm, 6) END AS ewm FROM f"""
)
def ewm_gaps(spark, sf):
    """A missing value carries the mean on."""
    return out(I.ewm(bars_with_gaps(spark, sf), "close", 14, min_periods=5).select("token", "ts", r("ewm")))


@query(
    with_views("bars_1h", recursive=True, extra={
        "gappy": GAPPY,
        "src": f"SELECT token, 'x' AS grp, 14 AS nr, 14 AS na, 14 AS nd, ts, open, high, low, close, volume FROM gappy WHERE {WHOLE}",
        **indicator_views("src"),
    })
    + """SELECT token, ts, round(rsi, 6) AS rsi, round(atr, 6) AS atr, round(adx, 6) AS adx, round(adx_pos, 6) AS adx_pos, round(adx_neg, 6) AS adx_neg
    FROM gappy LEFT JOIN (SELECT token, ts, rsi, atr, adx, adx_pos, adx_neg FROM ind) USING (token, ts)"""
)
def indicators_gaps(spark, sf):
    """Bars without a price get no indicator and leave those of later bars alone."""
    made = I.indicators(bars_with_gaps(spark, sf), rsi=14, atr=14, adx=14)
    return out(made.select("token", "ts", *[r(c) for c in ("rsi", "atr", "adx", "adx_pos", "adx_neg")]))


@query(with_views("bars_1h", extra={"num": NUMBERED, "trs": TRUE_RANGE}) + "SELECT token, ts, round(tr, 6) AS tr FROM trs")
def true_range(spark, sf):
    return out(I.with_true_range(V.bars_1h(spark, sf)).select("token", "ts", r("tr")))


@query(single(14, 14, 14) + "SELECT token, ts, round(rsi, 6) AS rsi FROM ind")
def rsi(spark, sf):
    return out(I.indicators(V.bars_1h(spark, sf), rsi=14).select("token", "ts", r("rsi")))


@query(single(14, 14, 14) + "SELECT token, ts, round(atr, 6) AS atr FROM ind")
def atr(spark, sf):
    return out(I.indicators(V.bars_1h(spark, sf), atr=14).select("token", "ts", r("atr")))


@query(single(14, 14, 14) + "SELECT token, ts, round(adx, 6) AS adx, round(adx_pos, 6) AS adx_pos, round(adx_neg, 6) AS adx_neg FROM ind")
def adx(spark, sf):
    return out(I.indicators(V.bars_1h(spark, sf), adx=14).select("token", "ts", r("adx"), r("adx_pos"), r("adx_neg")))


@query(single(14, 14, 14) + "SELECT token, ts, close, round(atr, 6) AS atr, round(atr / (close + 1e-9) * 100, 4) AS atr_normalized FROM ind")
def atr_normalized(spark, sf):
    a = I.indicators(V.bars_1h(spark, sf), atr=14)
    return out(a.select("token", "ts", "close", r("atr"), F.round(I.atr_normalized("atr", "close"), 4).alias("atr_normalized")))


PARAMS = [
    {"param_id": "a", "tf": "1h", "rsi": 14, "atr": 14, "adx": 10},
    {"param_id": "b", "tf": "1h", "rsi": 5, "atr": 40, "adx": 20},
    {"param_id": "c", "tf": "1h", "rsi": 21, "atr": 7, "adx": 30},
    {"param_id": "a", "tf": "4h", "rsi": 14, "atr": 14, "adx": 10},
    {"param_id": "b", "tf": "4h", "rsi": 9, "atr": 20, "adx": 14},
    {"param_id": "a", "tf": "1d", "rsi": 5, "atr": 5, "adx": 5},
]
SWEEP_SOURCE = (
    "SELECT token, p.tf || ':' || param_id AS grp, nr, na, nd, ts, open, high, low, close, volume, p.tf AS tf, param_id FROM bars JOIN (VALUES "
    + ", ".join(f"('{p['param_id']}', '{p['tf']}', {p['rsi']}, {p['atr']}, {p['adx']})" for p in PARAMS)
    + ") p(param_id, tf, nr, na, nd) ON bars.tf = p.tf"
)


@query(
    with_views("bars", recursive=True, extra={"src": SWEEP_SOURCE, **indicator_views("src")})
    + """SELECT token, tf, param_id, ts, round(rsi, 5) AS rsi, round(atr, 5) AS atr, round(adx, 5) AS adx, round(adx_pos, 5) AS adx_pos,
    round(adx_neg, 5) AS adx_neg FROM ind"""
)
def indicator_sweep(spark, sf):
    made = I.sweep(V.bars(spark, sf), PARAMS)
    return out(made.select("token", "tf", "param_id", "ts", r("rsi", 5), r("atr", 5), r("adx", 5), r("adx_pos", 5), r("adx_neg", 5)))


@query(
    with_views("bars_1h")
    + """SELECT token, ts, lag(close, 1) OVER w AS close_lag_1, lag(close, 2) OVER w AS close_lag_2, lag(close, 4) OVER w AS close_lag_4
    FROM bars_1h WINDOW w AS (PARTITION BY token ORDER BY ts)"""
)
def lag_features(spark, sf):
    return out(I.lag_features(V.bars_1h(spark, sf), ["close"]).select("token", "ts", "close_lag_1", "close_lag_2", "close_lag_4"))


@query(
    with_views("bars_1h")
    + """, s AS (SELECT token, ts, CASE WHEN volume > 3 THEN close END AS v FROM bars_1h)
    SELECT token, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY token ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled FROM s"""
)
def forward_fill(spark, sf):
    s = V.bars_1h(spark, sf).select("token", "ts", F.when(F.col("volume") > 3, F.col("close")).alias("v"))
    return out(B.forward_fill(s, ["v"]).withColumnRenamed("v", "filled"))


# ------------------------------------------------------------------ time features

CYC = ", ".join(
    f"round({f}(2 * pi() * {e}), 9) AS {n}_{f}"
    for n, e in (("day_of_week", "(isodow(ts) - 1) / 7.0::DOUBLE"), ("hour_of_day", "hour(ts) / 24.0::DOUBLE"), ("minute_of_hour", "minute(ts) / 60.0::DOUBLE"))
    for f in ("cos", "sin")
)


@query(with_views("ticks") + f"SELECT token, ts, {CYC} FROM ticks")
def cyclical_time(spark, sf):
    made = temporal.cyclical_time("ts")
    return out(V.ticks(spark, sf).select("token", "ts", *[F.round(c, 9).alias(n) for n, c in made.items()]))


SESSIONS = {
    "m": "SELECT *, hour(ts) * 60 + minute(ts) AS m FROM {source}",
    "s": """SELECT *, (m >= 1380 OR m <= 420) AS asia, m BETWEEN 420 AND 900 AS lon, m BETWEEN 900 AND 1380 AS ny,
        CASE WHEN m >= 1380 THEN m - 1380 ELSE m + 60 END AS a_since, CASE WHEN m >= 1380 THEN 1440 - m + 420 ELSE 420 - m END AS a_left FROM m""",
    "c": """SELECT *, CASE WHEN ny AND (NOT asia OR m - 900 < a_since) AND (NOT lon OR m - 900 < m - 420) THEN m - 900
        WHEN lon AND (NOT asia OR m - 420 < a_since) THEN m - 420 WHEN asia THEN a_since END AS since,
        CASE WHEN ny AND (NOT asia OR m - 900 < a_since) AND (NOT lon OR m - 900 < m - 420) THEN 1380 - m
        WHEN lon AND (NOT asia OR m - 420 < a_since) THEN 900 - m WHEN asia THEN a_left END AS rest FROM s""",
}
SESSION_COLUMNS = """asia::DOUBLE AS sess_asia_flag, lon::DOUBLE AS sess_london_flag, ny::DOUBLE AS sess_ny_flag, (m BETWEEN 420 AND 540)::DOUBLE AS kz_london_flag,
    (m BETWEEN 900 AND 1020)::DOUBLE AS kz_ny_flag, (isodow(ts) = 5)::DOUBLE AS friday_flag, floor(since / 15)::DOUBLE AS bars_since_session_open,
    ceil(rest / 15)::DOUBLE AS bars_to_session_close,
    CASE WHEN m BETWEEN 900 AND 1020 THEN floor((m - 900) / 15) WHEN m BETWEEN 420 AND 540 THEN floor((m - 420) / 15) ELSE 0 END::DOUBLE AS bars_since_kz_start,
    CASE WHEN m BETWEEN 900 AND 1020 THEN ceil((1020 - m) / 15) WHEN m BETWEEN 420 AND 540 THEN ceil((540 - m) / 15) ELSE 0 END::DOUBLE AS bars_to_kz_end,
    floor(m / 15)::DOUBLE AS bars_since_midnight_utc"""


def session_views(source):
    return {k: v.format(source=source) for k, v in SESSIONS.items()}


@query(with_views("ticks", extra=session_views("ticks")) + f"SELECT token, ts, {SESSION_COLUMNS} FROM c")
def session_features(spark, sf):
    return out(temporal.with_session_features(V.ticks(spark, sf).select("token", "ts")))


# ------------------------------------------------------------------ as-of joins


@query(
    with_views("bars_1h", "bars_4h")
    + """SELECT b.token, b.ts, b.close, h.close AS close_4h, h.ts_ AS ts_4h FROM bars_1h b
    ASOF LEFT JOIN (SELECT *, ts_ + INTERVAL 4 HOUR AS av FROM bars_4h) h ON h.token = b.token AND b.ts >= h.av"""
)
def asof_backward(spark, sf):
    b = V.bars(spark, sf)
    higher = b.filter("tf = '4h'").select("token", F.col("ts").alias("ts_4h"), "ts", F.col("close").alias("close_4h"))
    joined = asof.asof_join(V.bars_1h(spark, sf), {"h": asof.available_at(higher, 4 * 3600)})
    return out(joined.select("token", "ts", "close", F.col("h.close_4h"), F.col("h.ts_4h")))


@query(
    with_views("bars_1h", "econ_events")
    + """, hi AS (SELECT ts FROM econ_events WHERE lower(trim(impact)) = 'high')
    SELECT token, ts, (SELECT h.ts FROM hi h WHERE abs(epoch_us(h.ts) - epoch_us(b.ts)) <= 43200000000 ORDER BY abs(epoch_us(h.ts) - epoch_us(b.ts)), h.ts LIMIT 1) AS event_ts
    FROM bars_1h b"""
)
def asof_nearest(spark, sf):
    high = V.econ_events(spark, sf).filter(asof.is_high_impact("impact")).select("ts", F.col("ts").alias("event_ts"))
    joined = asof.asof_join(
        V.bars_1h(spark, sf).select("token", "ts"), {"e": high}, keys=(), direction="nearest", tolerance=12 * 3600 * 1_000_000, chunk=86400 * 1_000_000, spread=4
    )
    return out(joined.select("token", "ts", F.col("e.event_ts")))


EVENT = "EXISTS (SELECT 1 FROM econ_events h WHERE lower(trim(h.impact)) = 'high' AND abs(epoch_us(h.ts) - epoch_us({t}.ts)) <= {us})"


@query(with_views("bars_1h", "econ_events") + f"SELECT token, ts, {EVENT.format(t='b', us=7200000000)} AS economic_event FROM bars_1h b")
def event_flag(spark, sf):
    high = V.econ_events(spark, sf).filter(asof.is_high_impact("impact"))
    return out(asof.event_flag(V.bars_1h(spark, sf).select("token", "ts"), high, 7200))


# ------------------------------------------------------------------ feature table

TREND = ("adx", "adx_pos", "adx_neg", "atr_normalized")


def ft_views(windows, more: dict[str, tuple[str, dict[str, int], str]] | None = None) -> dict[str, str]:
    """Twin of the feature table. ``more``: column -> (role, n by horizon, expression with {n} and the window w)."""
    more = more or {}
    params = ", ".join(
        f"('{h}', '{V.HORIZON_ROLES[role]}', '{role}', {n[0] or 14}, {n[1]}, {n[2]})" for h, per in windows.items() for role, n in per.items()
    )
    source = f"""SELECT token, horizon || ':' || role AS grp, nr, na, nd, ts, open, high, low, close, volume, horizon, role FROM bars
    JOIN (VALUES {params}) p(horizon, tf, role, nr, na, nd) ON bars.tf = p.tf"""
    case = lambda role, h, n, e: f"WHEN role = '{role}' AND horizon = '{h}' AND i >= {n - 1} THEN {e.format(n=n, back=n - 1)}"
    added = "".join(f", CASE {' '.join(case(role, h, n, e) for h, n in per.items())} END AS {name}" for name, (role, per, e) in more.items())
    wanted = {r_: [*[(c, f"{c}_{r_}") for c in TREND], *[(n, n) for n, (role, _, _) in more.items() if role == r_]] for r_ in ("15m", "1h", "4h", "1d")}
    return {
        "src": source,
        **indicator_views("src"),
        "ft": "SELECT *, atr / (close + 1e-9) * 100 AS atr_normalized, ts + CASE role WHEN '1h' THEN INTERVAL 4 HOUR WHEN '4h' THEN INTERVAL 1 DAY WHEN '1d' THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END AS av"
        + f"{added} FROM ind",
        "ft_wide": "SELECT b.horizon, b.token, b.ts, b.rsi AS rsi_15m, "
        + ", ".join(f"b.{c} AS {n}" for c, n in wanted["15m"])
        + ", "
        + ", ".join(f"x{r_}.{c} AS {n}" for r_ in ("1h", "4h", "1d") for c, n in wanted[r_])
        + " FROM (SELECT * FROM ft WHERE role = '15m') b "
        + " ".join(f"ASOF LEFT JOIN (SELECT * FROM ft WHERE role = '{r_}') x{r_} ON x{r_}.horizon = b.horizon AND x{r_}.token = b.token AND b.ts >= x{r_}.av" for r_ in ("1h", "4h", "1d")),
        **session_views("ft_wide"),
    }


FT_VIEWS = ft_views(V.WINDOWS)
FT_NUMBERS = ["rsi_15m"] + [f"{c}_{x}" for x in ("15m", "1h", "4h", "1d") for c in TREND]


def _ft_sql(body: str, views: dict[str, str] = FT_VIEWS, more: tuple[str, ...] = ()) -> str:
    return with_views("bars", "econ_events", recursive=True, extra=views | {"full_ft": "SELECT horizon, token, ts, "
        + ", ".join(f"round({c}, 5) AS {c}" for c in [*FT_NUMBERS, *more]) + f", {CYC}, {SESSION_COLUMNS}, {EVENT.format(t='c', us=43200000000)} AS economic_event FROM c WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in [*FT_NUMBERS, *more])}) + body


def _features(spark, sf):
    high = V.econ_events(spark, sf).filter(asof.is_high_impact("impact"))
    return feature_plan.feature_table(V.bars(spark, sf), high, V.WINDOWS, V.HORIZON_ROLES)


def _rounded(df):
    numbers = [f"round({c}, {5 if c in FT_NUMBERS else 9}) AS {c}" for c in FEATURES]
    return out(df.selectExpr("horizon", "token", "ts", *numbers, "economic_event"))


@query(_ft_sql("SELECT * FROM full_ft"))
def feature_table(spark, sf):
    return _rounded(_features(spark, sf))


@query(_ft_sql("SELECT * FROM full_ft QUALIFY row_number() OVER (PARTITION BY horizon, token ORDER BY ts DESC) = 1"))
def latest_features(spark, sf):
    return _rounded(feature_plan.latest_features(_features(spark, sf)))


# All three horizons, with two features that a user adds to the standard ones.
OWN_WINDOWS = {"momentum_15m": {"1h": 3, "4h": 6, "8h": 12}, "volume_mean_4h": {"1h": 2, "4h": 3, "8h": 5}}
OWN_FEATURES = (
    Feature("momentum_15m", "15m", expression="close / lag(close, {n}) {over} - 1", inputs=("close",)),
    Feature("volume_mean_4h", "4h", expression="avg(volume) {rows}", inputs=("volume",)),
)
SERIES = "(PARTITION BY token, grp ORDER BY ts"
ALL_VIEWS = ft_views(
    V.ALL_WINDOWS,
    {
        "momentum_15m": ("15m", OWN_WINDOWS["momentum_15m"], f"close / lag(close, {{n}}) OVER {SERIES}) - 1"),
        "volume_mean_4h": ("4h", OWN_WINDOWS["volume_mean_4h"], f"avg(volume) OVER {SERIES} ROWS BETWEEN {{back}} PRECEDING AND CURRENT ROW)"),
    },
)


def all_features(spark, sf, events=None):
    """The feature table of all three horizons through the registry."""
    settings = settings_of(V.ALL_WINDOWS)
    for f in OWN_FEATURES:
        for horizon, n in OWN_WINDOWS[f.name].items():
            settings[horizon][f.role][f.name] = {"window": n}
    return feature_plan.feature_table(V.bars(spark, sf), events, roles=V.HORIZON_ROLES, features=(*standard_features(), *OWN_FEATURES), settings=settings)


def _all_rounded(df):
    return out(df.selectExpr("horizon", "token", "ts", *[f"round({c}, {5 if c in [*FT_NUMBERS, *OWN_WINDOWS] else 9}) AS {c}" for c in [*FEATURES, *OWN_WINDOWS]], "economic_event"))


@query(_ft_sql("SELECT * FROM full_ft", ALL_VIEWS, tuple(OWN_WINDOWS)))
def feature_table_all(spark, sf):
    return _all_rounded(all_features(spark, sf, V.econ_events(spark, sf).filter(asof.is_high_impact("impact"))))


@query(_ft_sql("SELECT * FROM full_ft QUALIFY row_number() OVER (PARTITION BY horizon, token ORDER BY ts DESC) = 1", ALL_VIEWS, tuple(OWN_WINDOWS)))
def latest_features_all(spark, sf):
    return _all_rounded(feature_plan.latest_features(all_features(spark, sf, V.econ_events(spark, sf).filter(asof.is_high_impact("impact")))))

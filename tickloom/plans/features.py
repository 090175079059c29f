"""The wide multi-timeframe feature table, for all tokens and horizons in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom import config
from tickloom.functions.temporal import cyclical_time, with_session_features
from tickloom.operators.asof import asof_rows, event_flag
from tickloom.operators.bars import dedupe_last
from tickloom.operators.indicators import atr_normalized, sweep
from tickloom.operators.registry import ROLES, Feature, resolve, settings_of, standard_features
from tickloom.operators.series import WEEK
from tickloom.operators.store import widen

def feature_table(
    bars: DataFrame,
    events: DataFrame | None = None,
    windows: dict[str, dict[str, tuple]] | None = None,
    roles: dict[str, str] | None = None,
    availability: str = "close",
    event_tolerance: int = config.EVENT_TOLERANCE_SECONDS,
    bar_minutes: int = 15,
    how: str | None = "any",
    chunk_seconds: int = WEEK,
    features: Sequence[Feature] | None = None,
    settings: dict | None = None,
) -> DataFrame:
    """One row per (horizon, token, base bar).

    ``features`` (the standard ones unless given) take their windows from ``settings``, horizon -> role -> feature -> window, else
    from ``windows``; all of them share one sweep. Columns of other than the standard features come last.

    ``roles`` maps the roles 15m, 1h, 4h, 1d to stored timeframes. Higher timeframes are
    known at their close (``availability="close"``; ``"open"`` looks ahead as the bar's
    opening time is used). The indicators of all timeframes and horizons are one sweep; its
    rows then meet in one as-of window per (token, horizon, chunk). ``events`` has (ts).
    ``how`` any/all drops incomplete rows, None keeps them.
    """
    roles = roles or {r: r for r in ROLES}
    settings = settings or settings_of(windows or config.WINDOWS)
    features = features or standard_features(r for r in ROLES if r in roles)
    base, higher = roles["15m"], [r for r in ROLES[1:] if r in roles]
    lengths = {roles[r]: config.TIMEFRAMES[roles[r]] for r in ROLES if r in roles}
    plan = resolve(features, settings, roles, bars.columns)
    swept = sweep(bars, plan.params, more=plan.more).withColumnRenamed("param_id", "horizon")
    if "atr" in swept.columns:
        swept = swept.withColumn("atr_normalized", atr_normalized("atr", "close"))
    made_of = {r: plan.outputs.get(r, {}) for r in ("15m", *higher)}
    higher = [r for r in higher if made_of[r]]

    shift = "0"
    if availability == "close":
        cases = [f"WHEN '{roles[r]}' THEN {lengths[roles[r]]}" for r in higher]
        shift = f"CASE tf {' '.join(cases)} ELSE 0 END" if cases else shift
    elif availability != "open":
        raise ValueError(f"unknown availability {availability!r}")
    pack = lambda pairs: ", ".join(f"'{name}', {c}" for name, c in pairs)
    left = [(c, c) for c in ("horizon", "token", "ts")] + list(made_of["15m"].items())
    rows = swept.selectExpr(
        "token",
        "horizon",
        f"(unix_seconds(ts) + {shift}) * 1000000 AS _at",
        f"int(tf = '{base}') AS _side",
        f"CASE WHEN tf = '{base}' THEN named_struct({pack(left)}) END AS _left",
        *[f"CASE WHEN tf = '{roles[r]}' THEN named_struct({pack(made_of[r].items())}) END AS _r_{r}" for r in higher],
    )
    horizons = ", ".join(f"'{h}'" for h in settings)
    spots = bars.filter(F.col("tf") == base).selectExpr("token", f"explode(array({horizons})) AS horizon", "unix_micros(ts) AS _at")
    if higher:
        wide = asof_rows(rows, spots, higher, ["token", "horizon"], chunk=chunk_seconds * 1_000_000)
    else:
        wide = rows.filter("_side = 1").select("_left.*")

    # unusable numbers go before the (never missing) time features are added
    numbers = [c for r in ("15m", *higher) for c in made_of[r]]
    flat = wide.selectExpr("horizon", "token", "ts", *made_of["15m"], *[f"`{r}`.*" for r in higher])
    clean = flat.selectExpr("horizon", "token", "ts", *[f"CASE WHEN abs({c}) < double('Infinity') THEN {c} END AS {c}" for c in numbers])
    if how is not None:
        clean = clean.dropna(how=how, subset=numbers)

    made = with_session_features(clean.withColumns(cyclical_time("ts")), "ts", bar_minutes)
    if events is not None:
        made = event_flag(made, events, event_tolerance, config.EVENT_FLAG)
    own = [c for c in numbers if c not in config.FEATURES]
    return widen(made).select("horizon", "token", "ts", *config.FEATURES, config.EVENT_FLAG, *own)


def latest_features(features: DataFrame, keys: Sequence[str] = ("horizon", "token")) -> DataFrame:
    """The newest row per key in one pass: every task ships one row per key."""
    return dedupe_last(features, keys, ["ts"])

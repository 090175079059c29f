"""Cyclical time and trading-session features as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed session bounds in minutes of the UTC day, both ends inclusive.
ASIA_OPEN, ASIA_CLOSE = 1380, 420
LONDON_OPEN, LONDON_CLOSE = 420, 900
NY_OPEN, NY_CLOSE = 900, 1380
LONDON_KZ_END, NY_KZ_END = 540, 1020
FRIDAY = 4


def cyclical_time(ts: str = "ts") -> dict[str, Column]:
    turns = {"day_of_week": f"weekday({ts}) / 7D", "hour_of_day": f"hour({ts}) / 24D", "minute_of_hour": f"minute({ts}) / 60D"}
    return {f"{name}_{f}": F.expr(f"{f}({2.0 * math.pi!r}D * ({turn}))") for name, turn in turns.items() for f in ("cos", "sin")}


def with_session_features(df: DataFrame, ts: str = "ts", bar_minutes: int = 15) -> DataFrame:
    """Add flags (0.0 / 1.0) and bar counters of the session opened last and of the kill-zone."""
    m = "_minute"
    asia = f"({m} >= {ASIA_OPEN} OR {m} <= {ASIA_CLOSE})"
    london = f"({m} BETWEEN {LONDON_OPEN} AND {LONDON_CLOSE})"
    ny = f"({m} BETWEEN {NY_OPEN} AND {NY_CLOSE})"
    kz_london = f"({m} BETWEEN {LONDON_OPEN} AND {LONDON_KZ_END})"
    kz_ny = f"({m} BETWEEN {NY_OPEN} AND {NY_KZ_END})"
    # sessions follow one another, so the one opened last is the later of two that touch;
    # at 23:00 that is Asia, which opens as New York closes
    case = lambda late, at_ny, at_london, early: (
        f"CASE WHEN {m} >= {ASIA_OPEN} THEN {late} WHEN {ny} THEN {at_ny} WHEN {london} THEN {at_london} ELSE {early} END"
    )
    since = case(f"{m} - {ASIA_OPEN}", f"{m} - {NY_OPEN}", f"{m} - {LONDON_OPEN}", f"{m} + {1440 - ASIA_OPEN}")
    left = case(f"{1440 + ASIA_CLOSE} - {m}", f"{NY_CLOSE} - {m}", f"{LONDON_CLOSE} - {m}", f"{ASIA_CLOSE} - {m}")
    zone = lambda at_ny, at_london: f"CASE WHEN {kz_ny} THEN {at_ny} WHEN {kz_london} THEN {at_london} ELSE 0 END"
    flag = lambda c: F.expr(f"double({c})")
    bars = lambda f, c: F.expr(f"double({f}(({c}) / {bar_minutes}))")
    made = {
        "sess_asia_flag": flag(asia),
        "sess_london_flag": flag(london),
        "sess_ny_flag": flag(ny),
        "kz_london_flag": flag(kz_london),
        "kz_ny_flag": flag(kz_ny),
        "friday_flag": flag(f"weekday({ts}) = {FRIDAY}"),
        "bars_since_session_open": bars("floor", since),
        "bars_to_session_close": bars("ceil", left),
        "bars_since_kz_start": bars("floor", zone(f"{m} - {NY_OPEN}", f"{m} - {LONDON_OPEN}")),
        "bars_to_kz_end": bars("ceil", zone(f"{NY_KZ_END} - {m}", f"{LONDON_KZ_END} - {m}")),
        "bars_since_midnight_utc": bars("floor", m),
    }
    minute = df.withColumn(m, F.expr(f"hour({ts}) * 60 + minute({ts})"))
    return minute.withColumns(made).drop(m)

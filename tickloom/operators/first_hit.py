"""First future row that crosses a stop or a target, however far ahead.

The series is indexed in levels of ``FANOUT`` entries: arrays of rows per block, arrays of
block extremes per super-block, and one short array of the highest extremes per key. A probe
climbs until a group ahead of it holds a crossing, then descends to the row. Every step is
an equi join that keeps one row per probe. A counting job chooses the number of levels from
the longest series, so no array outgrows its bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom.operators.series import POS

FANOUT = 128
TOP = 1024
# copies of the per-key arrays, so that the probes of a hot key spread
SALTS = 64

ENTRIES = "array_sort(collect_list(struct(at, low, high, ts))) AS items"


def levels_for(longest: int) -> int:
    """Levels below the per-key array that keep it within ``TOP`` entries."""
    levels = 1
    while longest > TOP * FANOUT**levels:
        levels += 1
    return levels


def longest_series(rows: DataFrame, keys: Sequence[str]) -> int:
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _index(rows: DataFrame, keys: Sequence[str], levels: int) -> list[DataFrame]:
    """Level k: (keys, _g, items) with items sorted by position; the last one is per key."""
    entries = rows.selectExpr(*keys, f"{POS} AS at", "low", "high", "ts")
    made = []
    for _ in range(levels):
        grouped = entries.withColumn("_g", F.expr(f"floor(at / {FANOUT})")).groupBy(*keys, "_g")
        made.append(grouped.agg(F.expr(ENTRIES)))
        entries = grouped.agg(F.expr("min(low) AS low"), F.expr("max(high) AS high"), F.expr("min(ts) AS ts")).withColumnRenamed("_g", "at")
    top = entries.groupBy(*keys).agg(F.expr(ENTRIES))
    made.append(top.withColumn("_g", F.expr(f"explode(sequence(0L, {SALTS - 1}L))")))
    return made


def first_hit(
    probes: DataFrame,
    rows: DataFrame,
    keys: Sequence[str] = ("token",),
    start: str = "start_pos",
    lower: str = "lower",
    upper: str = "upper",
    levels: int | None = None,
) -> DataFrame:
    """Add ``hit`` (struct at, low, high, ts; NULL if never): the first row of the key at or
    after position ``start`` with low <= lower or high >= upper. ``rows`` are positioned."""
    keys = list(keys)
    levels = levels or levels_for(longest_series(rows, keys))
    index = _index(rows, keys, levels)
    kept = list(probes.columns)
    ahead = lambda at: f"get(filter(items, x -> x.at >= {at} AND (coalesce(x.low <= {lower}, false) OR coalesce(x.high >= {upper}, false))), 0)"
    # a settled probe joins on a group that does not exist; its own start spreads it
    nowhere = f"-1L - {start}"
    found = probes.selectExpr(*kept, f"floor({start} / {FANOUT}) AS _g", f"{start} AS _from")
    # climb: search the own group of each level from there on, then everything above
    for level in range(levels + 1):
        found = found.join(index[level], [*keys, "_g"], "left")
        if level == 0:
            found = found.selectExpr(*kept, "_from", f"{ahead('_from')} AS _hit", "0 AS _level")
        else:
            fresh = f"CASE WHEN _hit IS NULL THEN {ahead('_from')} END"
            found = found.selectExpr(*kept, "_from", "_hit AS _old", "_level AS _was", f"{fresh} AS _new")
            found = found.selectExpr(*kept, "_from", "coalesce(_old, _new) AS _hit", f"CASE WHEN _new IS NOT NULL THEN {level} ELSE _was END AS _level")
        if level < levels:
            # the next level starts behind the group just searched
            onward = f"floor(_from / {FANOUT}) + 1"
            group = f"floor(({onward}) / {FANOUT})" if level + 1 < levels else f"pmod({onward}, {SALTS})"
            found = found.selectExpr(*kept, "_hit", "_level", f"{onward} AS _from", f"CASE WHEN _hit IS NULL THEN {group} ELSE {nowhere} END AS _g")
    # descend from the group that holds the first crossing to the row itself
    for level in range(levels - 1, -1, -1):
        below = f"_level > {level}"
        found = found.selectExpr(*kept, "_hit", "_level", f"CASE WHEN {below} THEN _hit.at ELSE {nowhere} END AS _g")
        found = found.join(index[level], [*keys, "_g"], "left").selectExpr(
            *kept, f"CASE WHEN {below} THEN {ahead('0')} ELSE _hit END AS _hit", f"least(_level, {level}) AS _level"
        )
    return found.selectExpr(*kept, "_hit AS hit")

"""As-of joins and the event flag.

Both sides are cut into chunks of the order axis, so the window that looks for the nearest
row runs over (key, chunk) and never over a whole key. What lies beyond a chunk comes from
one summary row per (key, chunk), carried along the chunks of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.operators.series import WEEK


def _axis(df: DataFrame, on: str) -> Column:
    instant = isinstance(df.schema[on].dataType, (T.TimestampType, T.TimestampNTZType))
    return F.unix_micros(F.col(on).cast("timestamp")) if instant else F.col(on).cast("long")


def asof_join(
    left: DataFrame,
    rights: dict[str, DataFrame],
    keys: Sequence[str] = ("token",),
    on: str = "ts",
    direction: str = "backward",
    tolerance: int | None = None,
    chunk: int = WEEK * 1_000_000,
    spread: int = 1,
) -> DataFrame:
    """Left as-of join of several right tables at once.

    Each right table (columns: keys, ``on``, values; unique per key and ``on``) adds one
    struct column named by its entry, NULL where nothing matches. ``direction`` is
    backward, forward or nearest (a tie takes the earlier row). ``tolerance`` and ``chunk``
    count axis units (microseconds for timestamps). Without keys, ``spread`` salts the left
    side and copies the right side that many times.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    parts = [*keys, "_salt"]
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
    rows = left.select(
        *keys, salt.alias("_salt"), _axis(left, on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left")
    )
    spots = rows.select(*parts, "_at")
    copies = F.array(*[F.lit(i) for i in range(spread)])
    for name, right in rights.items():
        side = right.select(
            *keys,
            F.explode(copies).alias("_salt"),
            _axis(right, on).alias("_at"),
            F.lit(0).alias("_side"),
            F.struct(*[c for c in right.columns if c not in keys]).alias(f"_r_{name}"),
        )
        rows = rows.unionByName(side, allowMissingColumns=True)
    return asof_rows(rows, spots, list(rights), parts, direction, tolerance, chunk)


def asof_rows(
    rows: DataFrame,
    spots: DataFrame,
    names: Sequence[str],
    parts: Sequence[str],
    direction: str = "backward",
    tolerance: int | None = None,
    chunk: int = WEEK * 1_000_000,
) -> DataFrame:
    """The as-of match inside one long frame.

    ``rows`` holds (parts, _at, _side, _left, _r_name...): side 1 rows carry ``_left``, side 0
    rows carry one right struct. ``spots`` lists (parts, _at) of the side 1 rows.
    """
    slot = f"floor(_at / {chunk}) AS _chunk"
    by = ", ".join(parts)
    base = ["_at", "_side", "_left"]
    spots = spots.selectExpr(*parts, slot).distinct()
    # a match travels with its axis value, to measure distances
    rows = rows.selectExpr(*parts, *base, slot, *[f"CASE WHEN `_r_{n}` IS NOT NULL THEN struct(_at AS at, `_r_{n}` AS row) END AS `_r_{n}`" for n in names])
    look_back, look_ahead = direction != "forward", direction != "backward"
    ways = [w for w, used in (("b", look_back), ("f", look_ahead)) if used]

    pick = {"b": "max_by", "f": "min_by"}
    summaries = [f"{pick[w]}(`_r_{n}`, CASE WHEN `_r_{n}` IS NOT NULL THEN _at END) AS `_{w}_{n}`" for n in names for w in ways]
    # one row per key and chunk of calendar
    ends = rows.filter("_side = 0").groupBy(*parts, "_chunk").agg(*[F.expr(x) for x in summaries])
    chunks = spots.join(ends, [*parts, "_chunk"], "full_outer")
    order = {"b": "_chunk", "f": "_chunk DESC"}
    beyond = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carried = [f"last(`_{w}_{n}`, true) OVER (PARTITION BY {by} ORDER BY {order[w]} {beyond}) AS `_c{w}_{n}`" for n in names for w in ways]
    chunks = chunks.selectExpr(*parts, "_chunk", *carried)

    order = {"b": "_at, _side", "f": "_at DESC, _side"}
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    inside = [f"last(`_r_{n}`, true) OVER (PARTITION BY {by}, _chunk ORDER BY {order[w]} {upto}) AS `_i{w}_{n}`" for n in names for w in ways]
    matched = rows.selectExpr(*parts, "_chunk", *base, *inside).filter("_side = 1").join(chunks, [*parts, "_chunk"], "left")

    nearest = {w: "coalesce(`_i{w}_{n}`, `_c{w}_{n}`)".replace("{w}", w) for w in ways}
    found = matched.selectExpr("_at", "_left", *[f"{nearest[w].replace('{n}', n)} AS `_{w}_{n}`" for n in names for w in ways])
    results = []
    for n in names:
        best = f"`_{ways[0]}_{n}`"
        if len(ways) == 2:
            back, ahead = f"`_b_{n}`", f"`_f_{n}`"
            best = f"CASE WHEN {back} IS NULL OR _at - {back}.at > {ahead}.at - _at THEN coalesce({ahead}, {back}) ELSE {back} END"
        if tolerance is not None:
            best = f"CASE WHEN abs(({best}).at - _at) <= {tolerance} THEN {best} END"
        results.append(f"({best}).row AS `{n}`")
    return found.selectExpr("_left.*", *results)


def available_at(bars: DataFrame, seconds: int, availability: str = "close") -> DataFrame:
    """Shift a higher-timeframe row to the instant it is known.

    ``close`` is free of look-ahead; ``open`` keeps the opening time.
    """
    if availability == "open":
        return bars
    if availability != "close":
        raise ValueError(f"unknown availability {availability!r}")
    return bars.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + seconds))


def is_high_impact(*candidates: str) -> Column:
    """True when the first given impact column says high, whatever its case and blanks."""
    return F.lower(F.trim(F.coalesce(*[F.col(c).cast("string") for c in candidates]))) == "high"


def event_flag(left: DataFrame, events: DataFrame, tolerance_seconds: int, name: str = "economic_event", on: str = "ts") -> DataFrame:
    """Flag rows that have an event within the tolerance, before or after.

    Events shrink to one row per tolerance-wide bucket (its neighbours' latest and earliest
    event), so the join is an equi join that never multiplies rows.
    """
    width = tolerance_seconds * 1_000_000
    at = F.unix_micros(on)
    slot = F.floor(at / F.lit(width))
    buckets = events.groupBy(slot.alias("_slot")).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    near = (
        buckets.select(
            F.explode(
                F.array(
                    F.struct((F.col("_slot") + 1).alias("_slot"), F.col("_hi").alias("_before"), F.lit(None).cast("long").alias("_after"), F.lit(False).alias("_same")),
                    F.struct(F.col("_slot"), F.lit(None).cast("long").alias("_before"), F.lit(None).cast("long").alias("_after"), F.lit(True).alias("_same")),
                    F.struct((F.col("_slot") - 1).alias("_slot"), F.lit(None).cast("long").alias("_before"), F.col("_lo").alias("_after"), F.lit(False).alias("_same")),
                )
            ).alias("n")
        )
        .select("n.*")
        .groupBy("_slot")
        .agg(F.max("_before").alias("_before"), F.min("_after").alias("_after"), F.max("_same").alias("_same"))
    )
    hit = F.col("_same") | (F.col("_before") >= at - width) | (F.col("_after") <= at + width)
    return (
        left.withColumn("_slot", slot)
        .join(near, "_slot", "left")
        .withColumn(name, F.coalesce(hit, F.col("_same"), F.lit(False)))
        .drop("_slot", "_before", "_after", "_same")
    )

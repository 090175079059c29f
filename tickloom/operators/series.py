"""Blocked series: the layout every order-dependent operator uses.

A series (one key) may hold a third of all rows, so no window runs over a whole key.
``position`` numbers the rows of each key densely from per-chunk counts; only the counts
(one row per key and calendar chunk) meet in a per-key window. ``blocked`` then cuts the
series into blocks of ``size`` positions and copies the ``before`` last rows of a block into
the next one (and the ``after`` first rows into the previous one) as a halo. Windows over
(key, block) see all the neighbours they need, and the blocks hash over the whole cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

POS, BLK, OWN, CHUNK = "_pos", "_blk", "_own", "_chunk"
WEEK = 7 * 86400
# exp(-44) < 1e-19: history older than this weighs less than one unit in the last place.
FORGET = 44.0
# exp(616) < 1e268: largest rescaling factor used inside one block.
RESCALE = 616.0


def chunk_id(ts: str | Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def position(
    df: DataFrame,
    keys: Sequence[str] = ("token",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    chunk_seconds: int = WEEK,
    valid: Column | None = None,
) -> DataFrame:
    """Add ``_pos``, the 0-based rank of the row in its key by (ts, tie).

    With ``valid`` only valid rows advance the position, so an invalid row shares the
    position of the last valid row before it (-1 in the head).
    """
    keys = list(keys)
    unit = F.lit(1).cast("long") if valid is None else F.when(valid, F.lit(1)).otherwise(F.lit(0)).cast("long")
    marked = df.withColumn(CHUNK, chunk_id(ts, chunk_seconds))
    sizes = marked.groupBy(*keys, CHUNK).agg(F.sum(unit).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(bases, [*keys, CHUNK])
        .withColumn(POS, F.col("_base") + F.sum(unit).over(inside) - F.lit(1))
        .drop("_base", CHUNK)
    )


def blocked(df: DataFrame, size: int | str, before: int | str = 0, after: int | str = 0) -> DataFrame:
    """Copy each positioned row into its block and, as halo, into the neighbour blocks.

    ``size``, ``before`` and ``after`` are numbers or column names.
    """
    home = f"floor({POS} / {size})"
    inner = f"({POS} - {home} * {size})"
    targets = [home]
    if before != 0:
        targets.append(f"CASE WHEN {inner} >= {size} - {before} THEN {home} + 1 END")
    if after != 0:
        targets.append(f"CASE WHEN {inner} < {after} AND {home} > 0 THEN {home} - 1 END")
    copies = df.selectExpr("*", f"explode(filter(array({', '.join(targets)}), b -> b IS NOT NULL)) AS {BLK}")
    return copies.selectExpr("*", f"{BLK} = {home} AS {OWN}")


def own(df: DataFrame, *drop: str) -> DataFrame:
    """Keep the home copy of every row."""
    return df.filter(OWN).drop(BLK, OWN, *drop)


def block_window(keys: Sequence[str], ts: str = "ts"):
    """Rows of a block in order; invalid rows, which share a position, follow by time."""
    return Window.partitionBy(*keys, BLK).orderBy(POS, ts)


def halo_windowed(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    before: int = 0,
    after: int = 0,
    ts: str = "ts",
    tie: Sequence[str] = (),
    chunk_seconds: int = WEEK,
    size: int | None = None,
) -> DataFrame:
    """Evaluate window columns (built on ``block_window``) that look at most ``before`` rows
    back and ``after`` rows ahead. Adds ``_pos``."""
    reach = max(before, after, 1)
    size = size or max(4096, 16 * reach)
    laid = blocked(position(df, keys, ts, tie, chunk_seconds), size, before, after)
    return own(laid.withColumns(columns))


# ------------------------------------------------------------------ decaying scans


def keep(window: int, wilder: bool = True) -> float:
    """Share of the old value kept per step for a smoothing window."""
    if window < 1:
        raise ValueError(f"smoothing window must be at least 1, got {window}")
    return 1.0 - 1.0 / window


def memory(window: int) -> int:
    """Rows after which the history of a smoothing window has no weight left."""
    q = keep(window)
    return 1 if q == 0.0 else math.ceil(FORGET / -math.log(q))


def reach(window: int) -> int:
    """Longest block, halo included, that one rescaled running sum can span."""
    q = keep(window)
    return 1 << 30 if q == 0.0 else int(RESCALE / -math.log(q))


def layout(windows: Sequence[int], lead_in: int = 2) -> tuple[int, int]:
    """(size, before) of blocks that serve all the smoothing windows at once."""
    before = max(memory(w) for w in windows) + lead_in * max(windows)
    size = min(reach(w) for w in windows) - before
    # Small and large windows together: keep the halo affordable, rescale in sub-blocks.
    return (min(size, 65536) if size >= 2 * before else 8 * before), before


def over(keys: Sequence[str], frame: str = "", more: str = "", ts: str = "ts") -> str:
    """SQL window clause of a block."""
    return f"OVER (PARTITION BY {', '.join([*keys, BLK])}{more} ORDER BY {POS}, {ts} {frame})"


RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def decay_scan(
    df: DataFrame,
    keys: Sequence[str],
    scans: dict[str, tuple[str, str]],
    size: int | str,
    before: int | str,
    rebase: bool = False,
) -> DataFrame:
    """Add y = q*y_previous + u for each ``{name: (u, q)}`` (SQL text) over blocked rows.

    The recurrence is the rescaled running sum q^j * sum(u * q^-j) with j counted from the
    block start. Null u counts as 0. ``rebase`` restarts the rescaling in sub-blocks, for
    blocks longer than ``reach``.
    """
    j = f"double({POS} - {BLK} * {size} + {before})"
    term = "coalesce({u}, 0D)"
    if not rebase:
        return df.withColumns(
            {
                name: F.expr(
                    f"CASE WHEN {q} = 0D THEN {term.format(u=u)} ELSE pow({q}, {j}) * sum({term.format(u=u)} * pow({q}, -{j})) {over(keys, RUNNING)} END"
                )
                for name, (u, q) in scans.items()
            }
        )
    # scans with the same decay share their sub-blocks
    decays = {q: i for i, q in enumerate(dict.fromkeys(q for _, q in scans.values()))}
    span = lambda q: f"CASE WHEN {q} = 0D THEN 1e9D ELSE floor({RESCALE}D / -ln({q})) END"
    df = df.withColumns({f"_sub{i}": F.expr(f"floor({j} / ({span(q)}))") for q, i in decays.items()})
    df = df.withColumns({f"_jj{i}": F.expr(f"{j} - _sub{i} * ({span(q)})") for q, i in decays.items()})
    sub = lambda i: f", _sub{i}"
    df = df.withColumns(
        {
            f"_loc_{name}": F.expr(
                f"CASE WHEN {q} = 0D THEN {term.format(u=u)} ELSE pow({q}, _jj{decays[q]}) * "
                f"sum({term.format(u=u)} * pow({q}, -_jj{decays[q]})) {over(keys, RUNNING, sub(decays[q]))} END"
            )
            for name, (u, q) in scans.items()
        }
    )
    df = df.withColumns(
        {
            f"_end_{name}": F.expr(f"CASE WHEN lead(1) {over(keys, '', sub(decays[q]))} IS NULL THEN _loc_{name} END")
            for name, (_, q) in scans.items()
        }
    )
    # rows of the same sub-block never see their own end: it is the last of them
    earlier = over(keys, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    df = df.withColumns(
        {
            name: F.expr(
                f"_loc_{name} + CASE WHEN {q} = 0D THEN 0D ELSE coalesce(last(_end_{name}, true) {earlier}, 0D) * pow({q}, _jj{decays[q]} + 1) END"
            )
            for name, (_, q) in scans.items()
        }
    )
    return df.drop(*[f"_{part}_{n}" for n in scans for part in ("loc", "end")], *[f"_{part}{i}" for i in decays.values() for part in ("sub", "jj")])

"""ATR barriers and first-touch labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.config import BARRIERS, LABEL_ATR_WINDOW, LABEL_HORIZONS
from tickloom.operators import series
from tickloom.operators.indicators import OK, of_whole, true_range, whole_bars
from tickloom.operators.series import POS

# column -> (price array, comparison that counts as a touch)
ABOVE = ("barrier_strong_bull", "barrier_bull", "barrier_bear_invalid")


def barrier_columns(atr: str | Column, close: str | Column = "close") -> dict[str, Column]:
    atr = F.col(atr) if isinstance(atr, str) else atr
    close = F.col(close) if isinstance(close, str) else close
    return {name: close + F.lit(sign * multiple) * atr for name, (sign, multiple) in BARRIERS.items()}


def _with_barriers(bars: DataFrame, keys: Sequence[str], window: int, after: int) -> DataFrame:
    size, before = series.layout([window], lead_in=1)
    laid = series.blocked(series.position(whole_bars(bars), keys), size, before, after)
    previous = F.lag("close").over(series.block_window(keys))
    tr = laid.withColumn("_tr", true_range("high", "low", previous))
    u = f"CASE WHEN {POS} = 0 THEN _tr ELSE _tr / {window} END"
    atr = series.decay_scan(tr, keys, {"atr": (u, f"{series.keep(window)!r}D")}, size, before)
    return atr.withColumns(barrier_columns("atr")).drop("_tr")


def atr_barriers(bars: DataFrame, keys: Sequence[str] = ("token",), window: int = LABEL_ATR_WINDOW) -> DataFrame:
    """ATR (exponential, from the first row) and the six barriers around the close."""
    made = series.own(_with_barriers(bars, [*keys, OK], window, 0), POS)
    return of_whole(made, "atr", *BARRIERS)


def touch_time(prices: str, barrier: str | Column, above: bool) -> Column:
    """Steps to the first future price that reaches the barrier; NULL if none does."""
    level = F.col(barrier) if isinstance(barrier, str) else barrier
    met = F.transform(prices, lambda p: (p >= level) if above else (p <= level))
    return F.nullif(F.array_position(met, True), F.lit(0).cast("long"))


def label_of(t: dict[str, Column]) -> Column:
    """First-touch label from the six touch times (NULL = never). Ties win nothing."""
    never = F.lit(float("inf"))
    v = {k: F.coalesce(c.cast("double"), never) for k, c in t.items()}
    return (
        F.when(v["barrier_strong_bull"] < v["barrier_bull_invalid"], 2)
        .when((v["barrier_bull"] < v["barrier_strong_bull"]) & (v["barrier_bull"] < v["barrier_bull_invalid"]), 1)
        .when(v["barrier_strong_bear"] < v["barrier_bear_invalid"], -2)
        .when((v["barrier_bear"] < v["barrier_strong_bear"]) & (v["barrier_bear"] < v["barrier_bear_invalid"]), -1)
        .otherwise(0)
    )


def labels_from_barriers(laid: DataFrame, keys: Sequence[str], horizons: dict[str, int]) -> DataFrame:
    """Labels of all horizons from one look-ahead array: a touch within the longest horizon
    belongs to a shorter one exactly when it comes in time."""
    longest = max(horizons.values())
    ahead = series.block_window(keys).rowsBetween(1, longest)
    arrays = laid.withColumns({"_highs": F.collect_list("high").over(ahead), "_lows": F.collect_list("low").over(ahead)})
    arrays = arrays.filter(series.OWN)
    touched = arrays.withColumns(
        {f"_t_{b}": touch_time("_highs" if b in ABOVE else "_lows", b, b in ABOVE) for b in BARRIERS}
    )
    made = {}
    for horizon, steps in horizons.items():
        within = {b: F.when(F.col(f"_t_{b}") <= steps, F.col(f"_t_{b}")) for b in BARRIERS}
        made[f"target_{horizon}"] = label_of(within)
        made[f"complete_{horizon}"] = F.size("_highs") >= steps
    return touched.withColumns(made).drop("_highs", "_lows", *[f"_t_{b}" for b in BARRIERS])


def _labelled(df: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """A bar without prices has no barriers, no label and is never complete."""
    some = [c for c in ("atr", *BARRIERS) if c in df.columns]
    whole = F.col(OK)
    done = {f"complete_{h}": F.col(f"complete_{h}") & whole for h in horizons}
    return of_whole(df.withColumns(done), *some, *[f"target_{h}" for h in horizons])


def barrier_labels(
    bars: DataFrame,
    horizons: dict[str, int] | None = None,
    keys: Sequence[str] = ("token",),
    window: int = LABEL_ATR_WINDOW,
) -> DataFrame:
    """Add ``target_h`` and ``complete_h`` for every horizon; incomplete rows are near the
    end of the series and saw a shorter future."""
    horizons = horizons or LABEL_HORIZONS
    keys = [*keys, OK]
    laid = _with_barriers(bars, keys, window, max(horizons.values()))
    return _labelled(series.own(labels_from_barriers(laid, keys, horizons), POS), horizons)


def labels_given_barriers(bars: DataFrame, horizons: dict[str, int], keys: Sequence[str] = ("token",)) -> DataFrame:
    """Same, for bars that already carry the six barrier columns."""
    reach = max(horizons.values())
    keys = [*keys, OK]
    laid = series.blocked(series.position(whole_bars(bars), keys), max(4096, 16 * reach), 0, reach)
    return _labelled(series.own(labels_from_barriers(laid, keys, horizons), POS), horizons)


def training_set(features: DataFrame, labels: DataFrame, horizons: Sequence[str], keys: Sequence[str] = ("token",)) -> DataFrame:
    """Features joined to the label of their own horizon: one row per (horizon, key, ts).

    ``features`` carries a ``horizon`` column. Labels unpivot to the same key, so the join
    hashes over (horizon, token, ts) and cannot be skewed.
    """
    long = labels.select(
        *keys,
        "ts",
        F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("target")) for h in horizons])).alias("l"),
    ).select(*keys, "ts", "l.*")
    return features.join(long, ["horizon", *keys, "ts"])


def first_touch(bars: DataFrame, levels: dict[str, bool], steps: int, keys: Sequence[str] = ("token",)) -> DataFrame:
    """Add ``t_<level>`` for every level column: in how many bars, up to ``steps``, a high
    reaches it (``True``) or a low falls to it (``False``); NULL if none does."""
    keys = [*keys, OK]
    laid = series.blocked(series.position(whole_bars(bars), keys), max(4096, 16 * steps), 0, steps)
    ahead = series.block_window(keys).rowsBetween(1, steps)
    arrays = laid.withColumns({"_highs": F.collect_list("high").over(ahead), "_lows": F.collect_list("low").over(ahead)})
    found = {f"t_{c}": touch_time("_highs" if above else "_lows", c, above) for c, above in levels.items()}
    return of_whole(series.own(arrays, POS).withColumns(found).drop("_highs", "_lows"), *found)

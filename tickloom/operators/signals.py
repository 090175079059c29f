"""Consensus of model outputs, stops and targets, position sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import config
from tickloom.operators.asof import asof_join


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def _first_label(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(label, score) of the largest score; the earlier label wins a tie."""
    best = F.greatest(*scores.values())
    label = F.coalesce(*[F.when(c == best, F.lit(name)) for name, c in scores.items()])
    return label, best


def consensus(
    preds: DataFrame,
    weights: dict[str, float] | None = None,
    by: Sequence[str] = ("token", "ts"),
    entry_price: str | None = None,
    labels: Sequence[str] = tuple(config.LABELS),
    moves: dict[str, float] | None = None,
    minimum_move: float = config.MINIMUM_MOVE_PCT,
    threshold: float = config.MIN_CONSENSUS_PROBABILITY,
) -> DataFrame:
    """Directive per decision from long predictions (by, model, label, prob).

    A model whose top label promises too small a move votes HOLD. Both steps aggregate
    fixed-width columns over fine keys, so they stay hash-based and unskewed.
    """
    moves = moves if moves is not None else config.EXPECTED_MOVE_PCT
    prices = [F.max(entry_price).alias("_entry")] if entry_price else []
    per_model = preds.groupBy(*by, "model").agg(
        *[F.max(F.when(F.col("label") == name, F.col("prob"))).alias(f"_p{i}") for i, name in enumerate(labels)], *prices
    )
    given = {name: F.coalesce(F.col(f"_p{i}"), F.lit(-1.0)) for i, name in enumerate(labels)}
    top, top_p = _first_label(given)
    top = F.when(top_p >= 0, top).otherwise("HOLD")
    weak = _lookup(moves, top, 0.0) < minimum_move
    votes = {
        name: F.when(weak, F.lit(1.0 if name == "HOLD" else 0.0)).otherwise(F.coalesce(F.col(f"_p{i}"), F.lit(0.0)))
        for i, name in enumerate(labels)
    }
    weighted = per_model.withColumns({"_w": _lookup(weights or {}, F.col("model"), 1.0), **{f"_v{i}": votes[n] for i, n in enumerate(labels)}})
    prices = [F.max("_entry").alias("_entry")] if entry_price else []
    total = F.sum("_w")
    merged = weighted.groupBy(*by).agg(
        *[F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col(f"_v{i}")), total), F.lit(0.0)).alias(f"_s{i}") for i in range(len(labels))], *prices
    )
    label, score = _first_label({name: F.col(f"_s{i}") for i, name in enumerate(labels)})
    decided = F.when(score < threshold, "HOLD").otherwise(label)
    if entry_price:
        decided = F.when(decided.isin("OPEN_LONG", "OPEN_SHORT") & F.col("_entry").isNull(), "HOLD").otherwise(decided)
    return merged.select(*by, decided.alias("directive"), label.alias("top_label"), score.alias("top_prob"), *([F.col("_entry").alias("entry_price")] if entry_price else []))


def stop_and_target(
    direction: Column,
    entry: Column,
    atr: Column,
    multiple: float = config.ATR_STOP_MULTIPLE,
    fallback_pct: float = config.FALLBACK_STOP_PCT,
    fixed_target: bool = False,
    target_pct: float = config.FIXED_TARGET_PCT,
    slippage_pct: float = config.SLIPPAGE_PCT,
    fee_pct: float = config.TAKER_FEE_PCT,
) -> dict[str, Column]:
    long = direction == "OPEN_LONG"
    usable = atr.isNotNull() & (atr > 0)
    distance = F.when(usable, atr * multiple).otherwise(entry * (fallback_pct / 100.0))
    stop = F.when(long, F.greatest(F.lit(0.0), entry - distance)).otherwise(entry + distance)
    share = max(0.0, target_pct / 100.0 + 2.0 * (slippage_pct / 100.0 + fee_pct / 100.0))
    target = F.when(long, entry * (1.0 + share)).otherwise(entry * (1.0 - share)) if fixed_target else F.lit(None).cast("double")
    return {"stop_loss": stop, "take_profit": target}


def trade_params(directives: DataFrame, atr: DataFrame, keys: Sequence[str] = ("token",), **settings) -> DataFrame:
    """Stop and target of OPEN directives from the latest ATR known at their time.

    ``atr`` has (keys, ts, atr); rows without a value are not looked at.
    """
    opens = directives.filter(F.col("directive").isin("OPEN_LONG", "OPEN_SHORT"))
    known = atr.filter(F.col("atr").isNotNull()).select(*keys, "ts", "atr")
    joined = asof_join(opens, {"_atr": known}, keys)
    made = stop_and_target(F.col("directive"), F.col("entry_price"), F.col("_atr")["atr"], **settings)
    return joined.withColumns({"atr": F.col("_atr")["atr"], **made}).drop("_atr")


def position_size(balance: Column, price: Column, stop: Column, mode: Column | str | None = None, **overrides: float) -> Column:
    """Asset quantity of the sizing mode, capped in notional; unusable input gives 0, an
    unusable price NULL."""
    s = {**config.SIZING, **overrides}
    mode = F.lit(mode or s["mode"]) if mode is None or isinstance(mode, str) else mode
    distance = F.abs(price - stop)
    risk = F.when(
        stop.isNotNull() & (distance > 0),
        F.try_divide(balance * (s["risk_percent"] / 100.0) * price * F.lit(float(s["leverage"])), distance),
    ).otherwise(0.0)
    notional = (
        F.when(mode == "percent_risk", risk)
        .when(mode == "percent_fixed", balance * (s["fixed_percent"] / 100.0))
        .when(mode == "usd_fixed", F.lit(float(s["fixed_usd"])))
        .otherwise(0.0)
    )
    if s["max_usd"] > 0:
        notional = F.least(notional, F.lit(float(s["max_usd"])))
    return F.when(price > 0, F.when(notional > 0, F.try_divide(notional, price)).otherwise(0.0))


def admissible(directives: DataFrame, size: str = "size", halted: bool = False) -> DataFrame:
    """Only OPEN directives with a positive size, and none while trading is halted."""
    return directives.filter(F.col("directive").isin("OPEN_LONG", "OPEN_SHORT") & (F.col(size) > 0) & F.lit(not halted))

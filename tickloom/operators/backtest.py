"""Candidate trades, non-overlapping selection and performance metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom import config
from tickloom.operators import series
from tickloom.operators.asof import asof_join
from tickloom.operators.bars import drop_incomplete
from tickloom.operators.dataset import assign_folds
from tickloom.operators.first_hit import first_hit
from tickloom.operators.series import POS
from tickloom.session import checkpoint


def mean_prediction(preds: DataFrame, by: Sequence[str] = ("token", "ts"), value: str = "pred") -> DataFrame:
    """Mean of the predictions there are, and the directive it implies."""
    mean = preds.groupBy(*by).agg(F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias("mean_pred"))
    return mean.withColumn("directive", F.when(F.col("mean_pred") > 0, "OPEN_LONG").otherwise("FLAT"))


def candidate_trades(
    bars: DataFrame,
    signals: DataFrame,
    keys: Sequence[str] = ("token",),
    stop: float | str = config.BACKTEST_STOP,
    target: float | str = config.BACKTEST_TARGET,
    slippage_pct: float = config.SLIPPAGE_PCT,
    fee_pct: float = config.TAKER_FEE_PCT,
    by: Sequence[str] = (),
) -> DataFrame:
    """The trade every long signal would open on the next bar.

    The stop wins over the target inside one bar; the last bar is never tested; a trade
    without a crossing closes at the last close. ``by`` names columns that tell signals of one bar
    apart (parameter sets, say): all of them share one series and one index. ``stop`` and ``target``
    may name columns of the signals.
    """
    keys, by = list(keys), list(by)
    own = [*by, *dict.fromkeys(c for c in (stop, target) if isinstance(c, str) and c not in by)]
    stop, target = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (stop, target))
    cost = (slippage_pct + fee_pct) / 100.0
    next_bar = {n: F.lead(c).over(series.block_window(keys)) for n, c in (("_next_open", "open"), ("entry_ts", "ts"))}
    placed = series.halo_windowed(bars.select(*keys, "ts", "open", "high", "low", "close"), keys, next_bar, after=1)
    last = bars.groupBy(*keys).agg(F.max_by("close", "ts").alias("_last_close"), F.max("ts").alias("_last_ts"))
    entry = F.col("_next_open") * (1.0 + slippage_pct / 100.0 + fee_pct / 100.0)
    probes = (
        placed.join(signals.select(*keys, "ts", *own), [*keys, "ts"], "inner" if own else "left_semi")
        .filter(F.col("_next_open").isNotNull())
        .select(*keys, *own, F.col("ts").alias("signal_ts"), F.col(POS).alias("signal_pos"), (F.col(POS) + 1).alias("start_pos"), "entry_ts", entry.alias("entry_price"))
        .withColumns({"lower": F.col("entry_price") * (1.0 - stop), "upper": F.col("entry_price") * (1.0 + target)})
    )
    tested = drop_incomplete(placed.select(*keys, "ts", POS, "low", "high"), 0, keys=keys)
    hit = first_hit(probes, tested, keys).join(last, keys)
    at_stop = F.col("hit")["low"] <= F.col("lower")
    raw = F.when(F.col("hit").isNull(), F.col("_last_close")).when(at_stop, F.col("lower")).otherwise(F.col("upper"))
    done = hit.select(
        *keys,
        *by,
        "signal_ts",
        "signal_pos",
        "entry_ts",
        "entry_price",
        F.coalesce(F.col("hit")["ts"], F.col("_last_ts")).alias("exit_ts"),
        F.col("hit")["at"].alias("exit_pos"),
        (raw * (1.0 - cost)).alias("exit_price"),
        F.when(F.col("hit").isNull(), "LAST_CLOSE").when(at_stop, "STOP_LOSS").otherwise("TAKE_PROFIT").alias("exit_reason"),
    )
    return done.withColumns(
        {"pnl": F.col("exit_price") - F.col("entry_price"), "ret": (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")}
    )


def select_trades(candidates: DataFrame, keys: Sequence[str] = ("token",)) -> DataFrame:
    """One position at a time: after a trade the next signal behind its exit bar is taken.

    Every candidate points to its successor; the chain from each key's first candidate is
    collected by pointer doubling: after k rounds 2^k links of every key are known.
    """
    keys = list(keys)
    # compact rows that every round and the result read again
    candidates = checkpoint(candidates)
    spots = candidates.select(*keys, F.col("signal_pos").alias("i"))
    after = candidates.filter(F.col("exit_pos").isNotNull()).select(*keys, F.col("signal_pos").alias("i"), (F.col("exit_pos") + 1).alias("at"))
    linked = asof_join(after, {"nx": spots.select(*keys, F.col("i").alias("at"), "i")}, keys, on="at", direction="forward", chunk=4096)
    jumps = checkpoint(linked.select(*keys, "i", F.col("nx")["i"].alias("n")).filter(F.col("n").isNotNull()))
    # every round adds a table of new links; none is written twice
    chain = spots.groupBy(*keys).agg(F.min("i").alias("i"))
    while not jumps.isEmpty():
        chain = chain.unionByName(checkpoint(chain.join(jumps, [*keys, "i"]).select(*keys, F.col("n").alias("i"))))
        onward = jumps.select(*keys, F.col("i").alias("n"), F.col("n").alias("n2"))
        jumps = checkpoint(jumps.join(onward, [*keys, "n"]).select(*keys, "i", F.col("n2").alias("n")))
    return candidates.join(chain.withColumnRenamed("i", "signal_pos"), [*keys, "signal_pos"], "left_semi")


def max_drawdown(
    trades: DataFrame,
    value: str = "pnl",
    keys: Sequence[str] = ("token",),
    order: str = "exit_ts",
    tie: Sequence[str] = (),
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Largest fall of the running sum below its running maximum (at most 0).

    Each chunk is reduced to sum, extremes and own drawdown, which compose along the key.
    """
    keys = list(keys)
    marked = trades.withColumn("_chunk", series.chunk_id(order, chunk_seconds))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    curve = marked.withColumn("_eq", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(inside))
    curve = curve.withColumn("_top", F.max("_eq").over(inside))
    chunks = curve.groupBy(*keys, "_chunk").agg(
        F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("_sum"),
        F.min("_eq").alias("_min"),
        F.max("_eq").alias("_max"),
        F.min(F.col("_eq") - F.col("_top")).alias("_dd"),
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    chunks = chunks.withColumn("_peak", F.max(F.col("_carry") + F.col("_max")).over(before))
    fall = F.least(F.col("_dd"), F.col("_carry") + F.col("_min") - F.col("_peak"))
    return chunks.groupBy(*keys).agg(F.min(fall).alias("max_drawdown"))


def sharpe_of(total: Column, squares: Column, n: Column, periods: float) -> Column:
    """Annualised mean/deviation of n periods from the sums of returns and their squares;
    periods without a trade count as zero returns."""
    mean = F.try_divide(total, n)
    var = F.try_divide(squares - n * mean * mean, n - F.lit(1))
    std = F.sqrt(F.when(var > 0, var))
    return F.coalesce(F.try_divide(mean, std) * F.lit(periods**0.5), F.lit(0.0))


def sharpe(trades: DataFrame, bars: DataFrame, keys: Sequence[str] = ("token",), periods: float = config.BARS_PER_YEAR_15M) -> DataFrame:
    """Sharpe ratio of per-bar returns: returns of trades that exit on one bar add up before
    they are squared, and both sides are reduced before they meet."""
    keys = list(keys)
    per_bar = trades.groupBy(*keys, "exit_ts").agg(F.sum("ret").alias("ret"))
    gains = per_bar.groupBy(*keys).agg(F.sum("ret").alias("_r"), F.sum(F.col("ret") * F.col("ret")).alias("_rr"))
    spans = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return spans.join(gains, keys, "left").select(
        *keys, sharpe_of(zero("_r"), zero("_rr"), F.col("_n").cast("double"), periods).alias("sharpe")
    )


def backtest_metrics(trades: DataFrame, bars: DataFrame, keys: Sequence[str] = ("token",), periods: float = config.BARS_PER_YEAR_15M) -> DataFrame:
    keys = list(keys)
    totals = trades.groupBy(*keys).agg(F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("num_trades"))
    return (
        sharpe(trades, bars, keys, periods)
        .join(totals, keys, "left")
        .join(max_drawdown(trades, "pnl", keys, "exit_ts"), keys, "left")
        .fillna({"total_pnl": 0.0, "num_trades": 0, "max_drawdown": 0.0})
    )


def promotion(metrics: DataFrame, role: str = "role", keys: Sequence[str] = ("token",), threshold_pct: float = config.PROMOTION_THRESHOLD_PCT) -> DataFrame:
    """Challenger against champion; a missing champion counts as 0."""
    side = lambda r: F.coalesce(F.max(F.when(F.col(role) == r, F.col("sharpe"))), F.lit(0.0))
    both = metrics.groupBy(*keys).agg(side("challenger").alias("challenger_sharpe"), side("champion").alias("champion_sharpe"))
    return both.withColumn("promote", F.col("challenger_sharpe") >= F.lit(1.0 + threshold_pct / 100.0) * F.col("champion_sharpe"))


def fold_mean(scores: DataFrame, by: Sequence[str] = ("param_id",), value: str = "sharpe") -> DataFrame:
    """Mean score over folds; a fold without a score counts as 0."""
    return scores.groupBy(*by).agg(F.avg(F.coalesce(F.col(value), F.lit(0.0))).alias("mean_score"))


def sweep_scores(
    bars: DataFrame,
    signals: DataFrame,
    sets: DataFrame,
    folds: DataFrame,
    keys: Sequence[str] = ("token",),
    param: str = "param_id",
    periods: float = config.BARS_PER_YEAR_15M,
) -> DataFrame:
    """(keys, fold, ``param``, num_trades, sharpe): every parameter set back-tested in the validation part of every fold, as one job.

    ``signals`` has (keys, ts, ``param``), ``sets`` has (``param``, stop, target), one row each. A fold is a series of its own,
    positioned and indexed once for all sets; sets meet the signals only. A set without trades in a fold scores 0 there;
    a set without any signal still has its rows. ``sets`` and ``folds`` are configuration and travel as arrays in one row.
    """
    keys = [*keys, "fold"]
    held = lambda df: assign_folds(df, folds).filter("part = 'val'").drop("part", "train_start", "train_end", "val_start", "val_end")
    parts = held(bars.select(*keys[:-1], "ts", "open", "high", "low", "close"))
    told = signals.select(*keys[:-1], "ts", param).dropDuplicates().join(F.broadcast(sets.select(param, "stop", "target")), param)
    trades = select_trades(candidate_trades(parts, held(told), keys, "stop", "target", by=[param]), [*keys, param])
    per_bar = trades.groupBy(*keys, param, "exit_ts").agg(F.sum("ret").alias("ret"), F.count(F.lit(1)).alias("n"))
    gains = per_bar.groupBy(*keys, param).agg(F.sum("ret").alias("_r"), F.sum(F.col("ret") * F.col("ret")).alias("_rr"), F.sum("n").alias("num_trades"))
    every = sets.agg(F.collect_set(param)).scalar()
    spans = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(param, F.explode(every))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return spans.join(gains, [*keys, param], "left").select(
        *keys,
        param,
        F.coalesce("num_trades", F.lit(0)).alias("num_trades"),
        sharpe_of(zero("_r"), zero("_rr"), F.col("_n").cast("double"), periods).alias("sharpe"),
    )

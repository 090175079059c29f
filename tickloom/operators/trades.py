"""Trade closing, KPIs, order fields, signal outcome rates, stop/target monitoring, report text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators import series
from tickloom.operators.asof import asof_join
from tickloom.operators.first_hit import first_hit
from tickloom.operators.series import POS

# Fixed direction words.
SHORT_WORDS = ["sell", "short"]


def realised_pnl(direction: Column, entry: Column, exit_: Column, size: Column, fees: Column) -> Column:
    gross = (exit_ - entry) * F.coalesce(size, F.lit(0.0))
    return F.when(F.lower(direction).isin(SHORT_WORDS), -gross).otherwise(gross) - F.coalesce(fees, F.lit(0.0))


def close_trades(entries: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """Fill exits into their trades: (trade_id, exit_price, exit_ts, fees) onto entries.

    Without ``exits`` every entry carries its own exit columns and nothing is joined; an exit counts once it has an ``exit_ts``.
    """
    if exits is None:
        closed = F.col("exit_ts").isNotNull()
        filled = entries.withColumns({"_closed": closed, **{c: F.when(closed, F.col(c)) for c in ("exit_price", "fees")}})
    else:
        filled = entries.join(exits.withColumn("_closed", F.lit(True)), "trade_id", "left")
    return filled.withColumns(
        {
            "pnl_usd": realised_pnl(*(F.col(c) for c in ("direction", "entry_price", "exit_price", "position_size", "fees"))),
            "status": F.when(F.col("_closed"), "CLOSED").otherwise("OPEN"),
        }
    ).drop("_closed")


def closed_since(trades: DataFrame, since: Column | None = None) -> DataFrame:
    closed = trades.filter(F.col("exit_ts").isNotNull())
    return closed if since is None else closed.filter(F.col("exit_ts") >= since)


def trade_kpis(trades: DataFrame, by: Sequence[str] = (), pnl_is_net: bool = False) -> DataFrame:
    """Win rate, profit factor and returns. Fees are subtracted unless ``pnl_is_net``; a
    result of exactly 0 is neither a win nor a loss."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    net = zero("pnl_usd") if pnl_is_net else zero("pnl_usd") - zero("fees")
    notional = zero("entry_price") * zero("position_size")
    sums = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.coalesce(F.sum((net > 0).cast("long")), F.lit(0)).alias("wins"),
        F.coalesce(F.sum((net < 0).cast("long")), F.lit(0)).alias("losses"),
        F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(F.when(net < 0, -net)), F.lit(0.0)).alias("gross_loss"),
        F.coalesce(F.sum(net), F.lit(0.0)).alias("net_pl_usd"),
        F.coalesce(F.avg(F.when(notional > 0, net / notional * 100.0)), F.lit(0.0)).alias("avg_pl_pct"),
    )
    return sums.withColumns(
        {
            "win_rate": F.coalesce(F.try_divide(F.col("wins"), F.col("total_trades")) * 100.0, F.lit(0.0)),
            "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(F.lit(float("inf"))),
        }
    )


def open_positions(positions: DataFrame) -> DataFrame:
    """The eight reporting columns; rows with an unusable value are skipped."""
    made = positions.select(
        F.col("account_name").alias("account"),
        "token",
        "direction",
        F.col("position_size").try_cast("double").alias("position_size"),
        F.col("entry_price").try_cast("double").alias("entry_price"),
        F.col("entry_timestamp").try_cast("long").alias("entry_time"),
        F.col("virtual_stop_loss").try_cast("double").alias("stop_loss"),
        F.col("virtual_take_profit").try_cast("double").alias("take_profit"),
    )
    return made.dropna(how="any", subset=["position_size", "entry_price", "entry_time", "stop_loss", "take_profit"])


def total_balance(balances: DataFrame, value: str = "balance", by: Sequence[str] = ()) -> DataFrame:
    """Sum of balances; one that cannot be read counts as 0."""
    return balances.groupBy(*by).agg(F.sum(F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))).alias("total_balance"))


ORDER_SCHEMA = (
    "average string, price string, timestamp string, lastTradeTimestamp string, "
    "info struct<avgPrice: string>, fee struct<cost: string>, fees array<struct<cost: string>>"
)


def order_fields(orders: DataFrame, json: str = "order_json", now: Column | None = None) -> DataFrame:
    """Fill price, time (ms) and fee of exchange order payloads; empty and zero alternates
    fall through to the next one."""
    o = F.from_json(json, ORDER_SCHEMA)
    given = lambda c: F.when((c != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c)
    parsed = orders.withColumn("_o", o)
    p = F.col("_o")
    price = F.coalesce(given(p["average"]), given(p["price"]), p["info"]["avgPrice"]).try_cast("double")
    at = F.coalesce(given(p["timestamp"]), given(p["lastTradeTimestamp"])).try_cast("long")
    if now is not None:
        at = F.coalesce(at, F.unix_millis(now))
    fee = F.when(p["fee"].isNotNull(), p["fee"]["cost"]).otherwise(F.get(p["fees"], F.lit(0))["cost"]).try_cast("double")
    return parsed.withColumns({"fill_price": price, "fill_ts_ms": at, "fill_fee": fee}).drop("_o")


def signal_precision_recall(signals: DataFrame, trades: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """OPEN signals are the positives, a positive net result is a realised win.

    ``trades`` has at most one row per signal_id. A missing run id is a group of its own.
    """
    outcomes = trades.select("signal_id", (F.col("net") > 0).alias("_win"))
    joined = signals.join(outcomes, "signal_id", "left")
    positive = F.col("label").isin("OPEN_LONG", "OPEN_SHORT")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sums = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signals"),
        n(positive & F.col("_win")).alias("true_positive"),
        n(positive & ~F.col("_win")).alias("false_positive"),
        n(~positive & F.col("_win")).alias("false_negative"),
    )
    rate = lambda other: F.coalesce(F.try_divide(F.col("true_positive"), F.col("true_positive") + F.col(other)), F.lit(0.0))
    return sums.withColumns({"precision": rate("false_positive"), "recall": rate("false_negative")})


def trigger_levels(direction: Column, stop: Column, target: Column) -> dict[str, Column]:
    """Lower and upper price levels that end a position."""
    long = F.lower(direction).isin("long", "open_long", "buy")
    return {"lower": F.when(long, stop).otherwise(target), "upper": F.when(long, target).otherwise(stop)}


def trigger_reason(direction: Column, stop: Column, price: Column) -> Column:
    """The stop is tested before the target."""
    long = F.lower(direction).isin("long", "open_long", "buy")
    stopped = F.when(long, price <= stop).otherwise(price >= stop)
    return F.when(F.coalesce(stopped, F.lit(False)), "STOP_LOSS").otherwise("TAKE_PROFIT")


def position_triggers(
    positions: DataFrame, ticks: DataFrame, keys: Sequence[str] = ("token",), tie: Sequence[str] = ("tick_id",), chunk_seconds: int = 3600
) -> DataFrame:
    """The first tick after the entry that hits stop or target, per position that is hit.

    Positions probe a block index of the ticks, so no position meets every later tick.
    """
    keys = list(keys)
    placed = series.position(ticks.select(*keys, "ts", "price", *tie), keys, "ts", tie, chunk_seconds)
    at_ts = placed.groupBy(*keys, "ts").agg(F.max(POS).alias("_p"))
    opened = positions.withColumn("ts", F.col("entry_ts"))
    begun = asof_join(opened, {"_t": at_ts}, keys, chunk=chunk_seconds * 1_000_000)
    probes = (
        begun.withColumn("start_pos", F.coalesce(F.col("_t")["_p"], F.lit(-1)) + 1)
        .withColumns(trigger_levels(F.col("direction"), F.col("stop_loss"), F.col("take_profit")))
        .drop("_t", "ts")
    )
    rows = placed.select(*keys, POS, "ts", F.col("price").alias("low"), F.col("price").alias("high"))
    hit = first_hit(probes, rows, keys).filter(F.col("hit").isNotNull())
    price = F.col("hit")["low"]
    return hit.withColumns(
        {"trigger_ts": F.col("hit")["ts"], "trigger_price": price, "reason": trigger_reason(F.col("direction"), F.col("stop_loss"), price)}
    ).drop("hit", "start_pos", "lower", "upper")


def money(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("$"), F.format_number(c, 2)), F.lit("?"))


def report_rows(kpis: DataFrame, positions: DataFrame, balance: DataFrame, title: str, top: int = 20) -> DataFrame:
    """(section, line, text) rows of a trade report; lists the first ``top`` positions in
    (account, token, entry time) order, ties by direction, size and price."""
    infinite = F.col("profit_factor") == float("inf")
    head = kpis.select(
        F.explode(
            F.array(
                F.struct(F.lit("title").alias("section"), F.lit(1).alias("line"), F.lit(title).alias("text")),
                F.struct(
                    F.lit("kpi").alias("section"),
                    F.lit(1).alias("line"),
                    F.concat(F.lit("P/L: "), money("net_pl_usd"), F.format_string(" (%.2f%%)", "avg_pl_pct")).alias("text"),
                ),
                F.struct(
                    F.lit("kpi").alias("section"),
                    F.lit(2).alias("line"),
                    F.concat(
                        F.format_string("Trades: %d | Win Rate: %.2f%% | Profit Factor: ", "total_trades", "win_rate"),
                        F.when(infinite, F.lit("∞")).otherwise(F.format_string("%.2f", "profit_factor")),
                    ).alias("text"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    total = balance.select(F.lit("balance").alias("section"), F.lit(1).alias("line"), F.concat(F.lit("Total Portfolio Value: "), money("total_balance")).alias("text"))
    order = ["account", "token", "entry_time", "direction", "position_size", "entry_price"]
    first = positions.orderBy(*order).limit(top)
    # at most ``top`` rows are left, so one small window numbers them
    listed = first.select(
        F.lit("position").alias("section"),
        F.row_number().over(series.Window.partitionBy(F.lit(0)).orderBy(*order)).alias("line"),
        F.concat(
            F.format_string("%s %s size=%.4f entry=", "token", "direction", "position_size"),
            money("entry_price"),
            F.lit(" SL="),
            money("stop_loss"),
            F.lit(" TP="),
            money("take_profit"),
        ).alias("text"),
    )
    return head.unionByName(total).unionByName(listed)

"""Metric-series normalisation: one function driven by a table of series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import finite, half_even_int, to_double
from tickloom.operators.bars import drop_incomplete


@dataclass(frozen=True)
class Metric:
    source: str
    name: str
    cadence: str
    keep: int
    drop_last: bool = False


# Fixed series: provider metric, output name, cadence, rows kept (0 = all), incomplete last row.
METRICS = [
    Metric("active_addresses_24h", "active_addresses_24h", "15m", 31),
    Metric("active_addresses_24h", "active_addresses_24h_1d", "1d", 0),
    Metric("transaction_volume_usd", "transaction_volume_usd_1d", "1d", 1),
    Metric("whale_transaction_count_100k_usd_to_inf", "whale_transaction_count_100k_usd_to_inf", "15m", 31),
    Metric("social_dominance_total", "social_dominance_total_15m", "15m", 97),
    Metric("sentiment_weighted_total", "sentiment_weighted_total_15m", "15m", 97),
    Metric("exchange_open_interest", "oi_total_15m", "15m", 97),
    Metric("liquidations_short", "shortLiqNotional_15m", "15m", 193),
    Metric("liquidations_long", "longLiqNotional_15m", "15m", 193),
    Metric("fees_burnt_usd", "fees_burnt_usd_15m", "15m", 2),
    Metric("fees_usd_intraday", "fees_usd_intraday_15m", "15m", 168),
    Metric("median_fees_usd_5m", "median_fees_usd_15m", "15m", 168),
    Metric("total_gas_used", "total_gas_used_15m", "15m", 96),
    Metric("social_dominance_total", "social_dominance_total_1d", "1d", 7),
    Metric("^GSPC", "spx_close_15m", "15m", 70, True),
    Metric("^GSPC", "spx_close_1d", "1d", 70, True),
    Metric("mvrv_long_short_diff_usd", "mvrv_long_short_diff_usd_1d", "1d", 0),
    Metric("network_profit_loss", "network_profit_loss_1d", "1d", 1),
    Metric("percent_of_total_supply_on_exchanges", "percent_of_total_supply_on_exchanges_1d", "1d", 91),
    Metric("etf_flow", "btc_etf_flow_1d", "1d", 7),
    Metric("DX-Y.NYB", "dxy_close_15m", "15m", 70, True),
    Metric("DX-Y.NYB", "dxy_close_1d", "1d", 70, True),
    Metric("GC=F", "gold_close_15m", "15m", 70, True),
    Metric("GC=F", "gold_close_1d", "1d", 70, True),
    Metric("^TNX", "ust10y_yield_1d", "1d", 31, True),
    Metric("whale_transaction_volume_1m_usd_to_inf", "whale_transaction_volume_1m_usd_to_inf", "15m", 31),
    Metric("DERIVATIVES_FUNDING_RATE_CURRENT", "funding_rate_last", "30m", 336, True),
    Metric("eth_supply", "eth_supply_15m", "15m", 2, True),
    Metric("btc_supply", "btc_supply_1d", "1d", 11, True),
    Metric("btc_dominance", "btc_dominance", "1d", 20, True),
    Metric("btc_market_cap", "btc_mcap_1d", "1d", 31, True),
    Metric("eth_market_cap", "eth_mcap_1d", "1d", 31, True),
    Metric("fear_and_greed", "crypto_fng_1d", "1d", 108, True),
    Metric("DERIVATIVES_MARK_PRICE", "mark_price_last", "15m", 672, True),
    Metric("perp_close", "perpClose_1h", "1h", 1, True),
    Metric("btc_perp_close", "btc_perpClose_7d", "7d", 2, True),
]


def normalize_metrics(raw: DataFrame, metrics: Sequence[Metric] = tuple(METRICS), keys: Sequence[str] = ("token",)) -> DataFrame:
    """Raw (keys, source, cadence, ts, value) to (keys, metric, ts, value), all series in one job.

    A flagged series loses its newest, incomplete row; a series with ``keep`` rows keeps its
    newest ones. Ranks are limited map-side, so long series ship few rows.
    """
    rules = F.array(
        *[
            F.struct(F.lit(m.source).alias("s"), F.lit(m.cadence).alias("c"), F.lit(m.name).alias("metric"), F.lit(m.keep).alias("_keep"), F.lit(m.drop_last).alias("_drop"))
            for m in metrics
        ]
    )
    mine = F.filter(rules, lambda r: (r["s"] == F.col("source")) & (r["c"] == F.col("cadence")))
    named = (
        raw.filter(F.col("source").isin(sorted({m.source for m in metrics})))
        .select(*keys, "ts", to_double("value").alias("value"), F.explode(mine).alias("r"))
        .select(*keys, "ts", "value", F.col("r")["metric"].alias("metric"), F.col("r")["_keep"].alias("_keep"), F.col("r")["_drop"].alias("_drop"))
    )
    longest = max(m.keep for m in metrics) + 1
    ranked = Window.partitionBy(*keys, "metric").orderBy(F.col("ts").desc(), F.col("value").desc())
    first = F.when(F.col("_drop"), 2).otherwise(1)
    last = F.col("_keep") + F.when(F.col("_drop"), 1).otherwise(0)
    bounded = (
        named.filter(F.col("_keep") > 0)
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= longest)
        .filter((F.col("_rank") >= first) & (F.col("_rank") <= last))
    )
    whole = named.filter(F.col("_keep") == 0)
    made = bounded.select(*keys, "metric", "ts", "value")
    if any(m.keep == 0 for m in metrics):
        made = made.unionByName(
            whole.filter(~F.col("_drop")).select(*keys, "metric", "ts", "value")
        ).unionByName(drop_incomplete(whole.filter("_drop"), 0, keys=[*keys, "metric"]).select(*keys, "metric", "ts", "value"))
    return made


# Fixed order of sources of a series that has alternates.
SOURCE_ORDER = {"mvrv_long_short_diff_usd_1d": ["mvrv_long_short_diff_usd", "mvrv"]}


def prefer_sources(raw: DataFrame, order: dict[str, Sequence[str]] | None = None, keys: Sequence[str] = ("token",), per_row: bool = False) -> DataFrame:
    """(keys, metric, ts, value, source) of metrics with several sources: all rows of the first source a series has a value of.

    With ``per_row`` every timestamp takes its first source with a value instead. ``raw`` has (keys, source, ts, value); equal
    timestamps of one source take the largest value. One aggregation; no row is compared with another.
    """
    order = order or SOURCE_ORDER
    ranks = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("s"), F.lit(i).alias("rank")) for m, sources in order.items() for i, s in enumerate(sources)])
    wanted = sorted({s for sources in order.values() for s in sources})
    known = raw.filter(F.col("source").isin(wanted)).withColumn("value", to_double("value")).filter(F.col("value").isNotNull() & F.col("ts").isNotNull())
    rows = known.withColumn("_r", F.explode(F.filter(ranks, lambda r: r["s"] == F.col("source")))).select(*keys, "ts", "value", "source", "_r.metric", "_r.rank")
    at = rows.groupBy(*keys, "metric", "ts").agg(F.max(F.struct((-F.col("rank")).alias("rank"), "value", "source")).alias("best"))
    if per_row:
        return at.select(*keys, "metric", "ts", "best.value", "best.source")
    one = rows.groupBy(*keys, "metric", "ts", "rank", "source").agg(F.max("value").alias("value"))
    first = rows.groupBy(*keys, "metric").agg(F.min("rank").alias("rank"))
    return one.join(first, [*keys, "metric", "rank"]).select(*keys, "metric", "ts", "value", "source")


def supply_estimate(circulating: Column, market_cap: Column, price: Column) -> Column:
    """Circulating supply, else market cap over price."""
    return F.coalesce(circulating, finite(F.try_divide(market_cap, price + F.lit(1e-12))))


def market_cap_estimate(market_cap: Column, price: Column, circulating: Column) -> Column:
    return F.coalesce(finite(market_cap), finite(price * circulating))


def dominance(df: DataFrame, candidates: Sequence[str] = ("btc_dominance", "usd_btc_dominance", "value")) -> Column:
    there = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def fear_greed(value: str | Column) -> Column:
    return half_even_int(value)


def liquidation_notional(
    df: DataFrame,
    keys: Sequence[str] = ("token",),
    sides: Sequence[str] = ("positionType", "position_type", "side", "position"),
    prices: Sequence[str] = ("price", "price_usd", "p"),
    volumes: Sequence[str] = ("volume", "qty", "amount", "size", "v"),
) -> DataFrame:
    """Liquidated notional per time, short and long in one pass. Without the raw columns,
    columns that are aggregated already pass through."""
    find = lambda names: next((c for c in names if c in df.columns), None)
    side, price, volume = find(sides), find(prices), find(volumes)
    outputs = {"shortLiqNotional_15m": "SHORT", "longLiqNotional_15m": "LONG"}
    if None in (side, price, volume):
        ready = [c for c in outputs if c in df.columns]
        if not ready:
            raise KeyError("neither raw nor aggregated liquidation columns")
        return df.select(*keys, "ts", *ready)
    notional = to_double(price) * to_double(volume)
    which = F.upper(F.col(side).cast("string"))
    used = df.filter(F.col("ts").isNotNull() & notional.isNotNull() & which.isin(list(outputs.values())))
    return used.groupBy(*keys, "ts").agg(*[F.sum(F.when(which == s, notional)).alias(c) for c, s in outputs.items()])

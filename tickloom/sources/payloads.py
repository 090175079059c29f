"""Provider payloads (JSON text) to rows; schemas are declared, nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import config
from tickloom.functions.timeparse import iso_to_ts, parse_ts
from tickloom.operators.bars import TICK_ORDER, tick_order

QUOTE_ITEM = (
    "struct<timestamp: string, time_open: string, time: string, quote: map<string, struct<price: double>>, "
    "circulating_supply: double, market_cap: double, total_supply: double>"
)


def flatten_quotes(df: DataFrame, json: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """``data`` maps a key to its items, or to an object with ``quotes``."""
    data = F.from_json(json, "data map<string, string>")["data"]
    entries = df.select(*keep, F.explode(data).alias("key", "_raw"))
    listed = F.from_json("_raw", f"array<{QUOTE_ITEM}>")
    nested = F.from_json("_raw", f"quotes array<{QUOTE_ITEM}>")["quotes"]
    items = entries.select(*keep, "key", F.explode(F.when(F.ltrim("_raw").startswith("["), listed).otherwise(nested)).alias("i"))
    i = F.col("i")
    return items.select(
        *keep,
        parse_ts(F.coalesce(i["timestamp"], i["time_open"], i["time"])).alias("ts"),
        "key",
        F.try_element_at(i["quote"], F.lit("USD"))["price"].alias("price_usd"),
        i["circulating_supply"].alias("circulating_supply"),
        i["market_cap"].alias("market_cap"),
        i["total_supply"].alias("total_supply"),
    )


LIST_FIELDS = ("value", "score", "market_cap", "total_market_cap", "total_volume_24h")


def flatten_list(df: DataFrame, json: str = "payload", usd_fields: Sequence[str] = ("btc_dominance",), keep: Sequence[str] = ()) -> DataFrame:
    """``data`` is a list; ``quote.USD`` members become ``usd_`` columns."""
    numbers = ", ".join(f"{f}: double" for f in LIST_FIELDS)
    usd = ", ".join(f"{f}: double" for f in usd_fields)
    schema = f"data array<struct<timestamp: string, time: string, date: string, {numbers}, quote: struct<USD: struct<{usd}>>>>"
    items = df.select(*keep, F.explode(F.from_json(json, schema)["data"]).alias("i"))
    i = F.col("i")
    return items.select(
        *keep,
        parse_ts(F.coalesce(i["timestamp"], i["time"], i["date"])).alias("ts"),
        *[i[f].alias(f) for f in LIST_FIELDS],
        *[i["quote"]["USD"][f].alias(f"usd_{f}") for f in usd_fields],
    )


def flatten_calendar(df: DataFrame, json: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    schema = "economicCalendar array<struct<time: string, event: string, country: string, impact: string, actual: double, estimate: double, prev: double>>"
    items = df.select(*keep, F.explode(F.from_json(json, schema)["economicCalendar"]).alias("i")).select(*keep, "i.*")
    return items.withColumn("ts", parse_ts("time")).drop("time").filter(F.col("ts").isNotNull())


def flatten_metric(df: DataFrame, metric: str, json: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """``data.getMetric.timeseriesData``, else the first member of ``data`` that has it."""
    series = "struct<timeseriesData: array<struct<datetime: string, value: double>>>"
    data = F.from_json(json, f"data map<string, {series}>")["data"]
    first = F.get(F.filter(F.transform(F.map_values(data), lambda m: m["timeseriesData"]), lambda s: s.isNotNull()), F.lit(0))
    points = F.coalesce(F.try_element_at(data, F.lit("getMetric"))["timeseriesData"], first)
    return df.select(*keep, F.explode(points).alias("p")).select(*keep, parse_ts(F.col("p")["datetime"]).alias("ts"), F.col("p")["value"].alias(metric))


BAR_RECORD = (
    "array<struct<time_period_start: string, time: string, price_open: double, price_high: double, price_low: double, "
    "price_close: double, volume_traded: double>>"
)


def flatten_bars(df: DataFrame, json: str = "payload", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(raw bar rows, quarantined payloads). A payload that is an object (an error) or not
    a list at all is quarantined whole."""
    parsed = df.withColumn("_rows", F.when(F.ltrim(json).startswith("["), F.from_json(json, BAR_RECORD)))
    good = parsed.filter(F.col("_rows").isNotNull()).select(*keep, F.explode("_rows").alias("r")).select(*keep, "r.*")
    bad = parsed.filter(F.col("_rows").isNull()).select(*keep, json)
    return good, bad


def normalize_bars(raw: DataFrame, interval: str, token: Column | str | None = None) -> DataFrame:
    """Provider bar columns to the bar table's columns; rows without a time are dropped."""
    names = {"price_open": "open", "price_high": "high", "price_low": "low", "price_close": "close", "volume_traded": "volume"}
    df = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    times = [c for c in ("time_period_start", "time", "timestamp") if c in df.columns]
    named = F.lit(token) if isinstance(token, str) else token if token is not None else F.col("token")
    return df.select(
        parse_ts(F.coalesce(*[F.col(c).cast("string") for c in times])).alias("ts"),
        named.alias("token"),
        F.lit(interval).alias("tf"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
    ).filter(F.col("ts").isNotNull())


def pick(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate column there is."""
    return next((c for c in candidates if c in df.columns), None)


def normalize_values(df: DataFrame, columns: dict[str, Sequence[str]], keep: Sequence[str] = ("token",), time: str = "timestamp") -> DataFrame:
    """Coalesce alternates into fixed columns: {output: candidates}."""
    made = []
    for name, candidates in columns.items():
        there = [F.col(c).try_cast("double") for c in candidates if c in df.columns]
        made.append((F.coalesce(*there) if there else F.lit(None).cast("double")).alias(name))
    return df.select(*keep, parse_ts(time).alias("ts"), *made).filter(F.col("ts").isNotNull())


def normalize_funding(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return normalize_values(df, {"rate": ("funding_rate", "rate", "value", "v")}, time=time)


def normalize_social(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return normalize_values(
        df,
        {"social_dominance": ("social_dominance", "social_dominance_24h"), "sentiment": ("sentiment", "sentiment_score")},
        time=time,
    )


def base_token(symbol: str | Column) -> Column:
    """Base token of an underscore-separated symbol; NULL if there is none."""
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    parts = F.split(symbol, "_")
    second_last, last = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    return F.when(F.size(parts) >= 4, F.when((last != "") & (second_last != ""), second_last)).when(F.size(parts) == 3, F.try_element_at(parts, F.lit(3)))


def provider_symbol(token: str | Column, symbols: dict[str, str] | None = None) -> Column:
    """Symbol from the token dimension (configuration), else the spot pattern."""
    if symbols is None:
        symbols = {t: s for t, (_, s) in config.TOKENS.items()}
    upper = F.upper(F.col(token) if isinstance(token, str) else token)
    pairs = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, upper), F.concat(F.lit("BINANCE_SPOT_"), upper, F.lit("_USDT")))


def with_symbols(df: DataFrame, dimension: DataFrame, token: str = "token", name: str = "symbol", provider: str | None = None) -> DataFrame:
    """Add the provider's symbol from a dimension table (token, symbol, optionally provider and valid_from), else the spot pattern.

    Of several rows of a token the newest ``valid_from`` counts, of equal ones the smallest symbol. The dimension is reduced to one row
    per token first; its size decides whether the join broadcasts it.
    """
    rows = dimension if provider is None else dimension.filter(F.col("provider") == provider)
    newest = F.struct(F.col("valid_from") if "valid_from" in rows.columns else F.lit(0).alias("valid_from"))
    ranked = rows.groupBy(F.upper("token").alias("_token")).agg(F.max(newest).alias("_at"), F.collect_set(F.struct(newest.alias("at"), "symbol")).alias("_all"))
    known = ranked.select("_token", F.array_min(F.transform(F.filter("_all", lambda x: x["at"].eqNullSafe(F.col("_at"))), lambda x: x["symbol"])).alias("_symbol"))
    joined = df.join(known, F.upper(F.col(token)) == F.col("_token"), "left")
    spot = F.concat(F.lit("BINANCE_SPOT_"), F.upper(F.col(token)), F.lit("_USDT"))
    return joined.withColumn(name, F.coalesce("_symbol", spot)).drop("_token", "_symbol")


# Fixed names of a time column in downloads, and of their columns.
TABULAR_TIMES = ("timestamp", "Date", "Datetime", "index", "date", "time")
TABULAR_NAMES = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}


def tabular(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A downloaded table of prices: its time column (by name, first found) as ts, columns under the bar table's names, doubles.

    A table with only an adjusted close has it as close. Rows without a time are dropped; so are all rows of a table without a
    time column. Cells that are no number are NULL.
    """
    time = pick(df, TABULAR_TIMES)
    names = {c: TABULAR_NAMES.get(c, c) for c in df.columns}
    columns: dict[str, Column] = {}
    for c, name in names.items():
        if name in ("open", "high", "low", "close", "adj_close", "volume") and name not in columns:
            columns[name] = F.col(f"`{c}`").try_cast("double")
    if "close" not in columns and "adj_close" in columns:
        columns["close"] = columns["adj_close"]
    ts = parse_ts(F.col(f"`{time}`").cast("string")) if time else F.lit(None).cast("timestamp")
    return df.select(*keep, ts.alias("ts"), *[v.alias(k) for k, v in columns.items()]).filter(F.col("ts").isNotNull())


TRADE = "type string, symbol_id string, time_exchange string, price string, size string, sequence long"


def decode_trades(df: DataFrame, json: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Trade messages to ticks, for batch and streams; other messages and unusable trades
    are dropped. ``tick_order`` tells which tick came first, across symbols of a token and without a sequence."""
    # a generator keeps later filters from repeating the parse
    m = df.select(*keep, F.inline(F.array(F.from_json(json, TRADE)))).filter("type = 'trade'")
    read = m.withColumns({"_ts": iso_to_ts(F.col("time_exchange")), "_price": F.col("price").try_cast("double"), "_qty": F.col("size").try_cast("double")})
    ticks = read.select(
        *keep,
        base_token("symbol_id").alias("token"),
        F.timestamp_millis(F.unix_millis("_ts")).alias("ts"),
        F.col("_price").alias("price"),
        F.col("_qty").alias("qty"),
        F.col("sequence").alias("tick_id"),
        tick_order("_ts", "symbol_id", "sequence", "_price", "_qty").alias(TICK_ORDER),
    )
    return ticks.dropna(how="any", subset=["token", "ts", "price", "qty"]).filter(F.col("token") != "")

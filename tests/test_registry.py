"""Features by name, cut points, type names, downloads and source priority."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import metrics as M
from tickloom.operators import dataset as D, store
from tickloom.operators.registry import STANDARD, Feature, resolve, setting, settings_of, standard_features
from tickloom.plans.features import feature_table
from tickloom.sources import payloads as P

WINDOWS = {"1h": {"15m": (5, 4, 3), "1h": (None, 3, 3)}, "8h": {"15m": (7, 6, 4), "1h": (None, 2, 2)}}
ROLES = {"15m": "15m", "1h": "1h"}
COLUMNS = ["token", "tf", "ts", "open", "high", "low", "close", "volume"]
TWO = standard_features(ROLES)


def test_standard_features_resolve_to_the_window_table():
    made = resolve(TWO, settings_of(WINDOWS), ROLES, COLUMNS)
    rows = {(p["param_id"], p["tf"]): (p["rsi"], p["atr"], p["adx"]) for p in made.params}
    assert rows == {("1h", "15m"): (5, 4, 3), ("1h", "1h"): (None, 3, 3), ("8h", "15m"): (7, 6, 4), ("8h", "1h"): (None, 2, 2)}
    assert list(made.outputs["15m"]) == ["rsi_15m", "adx_15m", "adx_pos_15m", "adx_neg_15m", "atr_normalized_15m"] and made.more == {}
    assert len(STANDARD) == 9


@pytest.mark.parametrize(
    "settings, error, message",
    [
        ({}, KeyError, "missing setting 15m/adx_15m/window"),
        ({"15m": {}}, KeyError, r"missing setting 15m/adx_15m/window \(no 15m/adx_15m\)"),
        ({"15m": {"adx_15m": {}}}, KeyError, "no 15m/adx_15m/window"),
        ({"15m": {"adx_15m": {"window": "x"}}}, ValueError, "15m/adx_15m/window must be a whole number"),
        ({"15m": {"adx_15m": {"window": 2.5}}}, ValueError, "at least 1"),
        ({"15m": {"adx_15m": {"window": 0}}}, ValueError, "at least 1"),
        ({"15m": {"adx_15m": {"window": True}}}, ValueError, "at least 1"),
    ],
)
def test_errors_name_the_path(settings, error, message):
    with pytest.raises(error, match=message):
        setting(settings, ["15m", "adx_15m", "window"])


def test_number_texts_are_windows():
    assert setting({"a": {"b": "30"}}, ["a", "b"]) == 30


def test_wrong_features_are_errors():
    own = Feature("m", "15m", expression="avg(close) {rows}", inputs=("close",))
    settings = settings_of(WINDOWS)
    with pytest.raises(KeyError, match="1h/15m/m/window"):
        resolve([*TWO, own], settings, ROLES, COLUMNS)
    for h in settings:
        settings[h]["15m"] |= {"m": {"window": 3}, "other": {"window": 9}}
    with pytest.raises(KeyError, match=r"missing input columns \['close'\]"):
        resolve([own], settings, ROLES, ["ts"])
    with pytest.raises(ValueError, match="made twice"):
        resolve([*TWO, own, own], settings, ROLES, COLUMNS)
    with pytest.raises(ValueError, match="two windows"):
        resolve([*TWO, Feature("other", "15m", {"o": "adx"}, "adx")], settings, ROLES, COLUMNS)
    with pytest.raises(KeyError, match="no timeframe for role 1d"):
        resolve([Feature("x", "1d", engine="rsi", outputs={"x": "rsi"})], settings, ROLES, COLUMNS)
    with pytest.raises(ValueError, match="an engine or an expression"):
        Feature("x", "1d")
    with pytest.raises(ValueError, match="unknown engine"):
        Feature("x", "1d", engine="macd")


@pytest.fixture
def bars(spark):
    base = spark.range(400).select(F.lit("t").alias("token"), F.lit("15m").alias("tf"), F.timestamp_seconds(F.col("id") * 900).alias("ts"), F.col("id"))
    hours = spark.range(100).select(F.lit("t").alias("token"), F.lit("1h").alias("tf"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") * 4).alias("id"))
    price = 100 + F.sin(F.col("id") / 7) * 5 + F.col("id") % 3
    rows = base.unionByName(hours).withColumn("close", price)
    return rows.select("token", "tf", "ts", (F.col("close") - 0.5).alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), "close", F.col("id").cast("double").alias("volume"))


def test_own_features_share_the_table(bars):
    settings = settings_of(WINDOWS)
    own = (Feature("rise", "15m", expression="close / lag(close, {n}) {over} - 1", inputs=("close",)), Feature("lots", "1h", {"lots_1h": "lots"}, expression="sum(volume) {rows}", inputs=("volume",)))
    for h, n in (("1h", 2), ("8h", 5)):
        settings[h]["15m"]["rise"] = {"window": n}
        settings[h]["1h"]["lots"] = {"window": n}
    made = feature_table(bars, roles=ROLES, features=[*TWO, *own], settings=settings)
    plain = feature_table(bars, windows=WINDOWS, roles=ROLES)
    assert made.columns == [*plain.columns, "rise", "lots_1h"]
    closes = {r.ts: r.close for r in bars.filter("tf = '15m'").collect()}
    order = sorted(closes)
    rows = made.collect()
    assert {r.horizon for r in rows} == {"1h", "8h"} and len(rows) > 600
    for r in rows:
        n = 2 if r.horizon == "1h" else 5
        i = order.index(r.ts)
        assert r.rise == pytest.approx(closes[r.ts] / closes[order[i - n]] - 1)
        hour = i // 4 - 1  # the last hour that has closed
        assert r.lots_1h == sum(4 * k for k in range(hour - n + 1, hour + 1))
    same = {(r.horizon, r.ts): r.adx_15m for r in plain.collect()}
    assert all(same[r.horizon, r.ts] == r.adx_15m for r in rows)


def test_features_of_one_timeframe_only(bars):
    own = Feature("rise", "15m", expression="close - lag(close, {n}) {over}", inputs=("close",))
    made = feature_table(bars, roles=ROLES, features=[own], settings={"1h": {"15m": {"rise": {"window": 3}}}})
    assert made.count() == 397 and "rise" in made.columns


def test_cut_points_read_the_table_three_times(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.timestamp_seconds(F.floor(F.col("id") / 3) * 60).alias("ts"), F.col("id").cast("string").alias("token")).write.parquet(path)
    df = spark.read.parquet(path)
    made = D.prepared(df.withColumn("y", F.lit(1)), "y")
    rows = made.collect()
    text = made._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") <= 4
    parts = {p: sum(r.split == p for r in rows) for p in ("train", "val", "test")}
    assert parts == {"train": 700, "val": 100, "test": 200}
    newest = max(r.ts for r in rows if r.split == "train")
    assert {r.weight for r in rows if r.ts == newest and r.split == "train"} == {1.0}
    assert D.prepared(df.withColumn("y", F.lit(1)).limit(0), "y").collect() == []


def test_type_names(frame):
    made = store.conform(frame([("true", "1.5", "7")], "a string, b string, c string"), {"a": " Boolean", "b": "FLOAT", "c": "str", "d": "int64", "e": None})
    assert made.dtypes == [("a", "boolean"), ("b", "double"), ("c", "string"), ("d", "bigint"), ("e", "double")]
    assert made.first()[:] == (True, 1.5, "7", None, None)


def test_downloads_without_a_time_have_no_rows(frame):
    assert P.tabular(frame([("1", "2")], "Close string, `Adj Close` string")).count() == 0
    made = P.tabular(frame([("2024-01-02", "1", "2", "x")], "Date string, Close string, `Adj Close` string, other string"))
    assert made.columns == ["ts", "close", "adj_close"] and made.select("close", "adj_close").first()[:] == (1.0, 2.0)


def test_second_source_only_where_the_first_is_absent(frame):
    rows = [("a", "mvrv", 1, 5.0), ("a", "mvrv_long_short_diff_usd", 2, 6.0), ("b", "mvrv", 1, 7.0), ("b", "mvrv_long_short_diff_usd", 1, None), ("b", "mvrv", 1, 8.0), ("c", "x", 1, 1.0)]
    raw = frame(rows, "token string, source string, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert sorted((r.token, r.value, r.source) for r in M.prefer_sources(raw).collect()) == [("a", 6.0, "mvrv_long_short_diff_usd"), ("b", 8.0, "mvrv")]
    assert sorted((r.token, r.value) for r in M.prefer_sources(raw, per_row=True).collect()) == [("a", 5.0), ("a", 6.0), ("b", 8.0)]


def test_symbols_of_the_newest_version(frame):
    dimension = frame([("btc", "OLD", 1), ("BTC", "Z_NEW", 2), ("btc", "A_NEW", 2), (None, "N", 9)], "token string, symbol string, valid_from int")
    made = P.with_symbols(frame([("BTC", 1), ("eth", 2), (None, 3)], "token string, i int"), dimension)
    assert {r.i: r.symbol for r in made.collect()} == {1: "A_NEW", 2: "BINANCE_SPOT_ETH_USDT", 3: None}

"""Consensus, sizing, triggers, trade results, storage, payloads: pinned values."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import signals as S, store, trades as T
from tickloom.sources import payloads as P

LIT = F.lit


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_consensus_needs_move_probability_and_price(frame):
    rows = [
        ("a", "m", "OPEN_LONG", 0.9, 50000.0),
        ("b", "m", "OPEN_LONG", 0.5, 50000.0),
        ("c", "m", "EXIT_LONG", 0.9, 50000.0),
        ("d", "m", "OPEN_SHORT", 0.9, None),
        ("e", "m1", "OPEN_LONG", 0.6, 1.0),
        ("e", "m2", "OPEN_SHORT", 0.6, 1.0),
        ("f", "m", "OPEN_SHORT", 0.7, 1.0),
        ("f", "m", "OPEN_LONG", 0.7, 1.0),
    ]
    df = frame(rows, "token string, model string, label string, prob double, price double")
    got = {r.token: r.directive for r in S.consensus(df, by=["token"], entry_price="price").collect()}
    assert got == {"a": "OPEN_LONG", "b": "HOLD", "c": "HOLD", "d": "HOLD", "e": "HOLD", "f": "OPEN_LONG"}


def test_stop_and_target(spark):
    made = S.stop_and_target(LIT("OPEN_LONG"), LIT(50000.0), LIT(1000.0))
    r = one(spark, **made)
    assert (r.stop_loss, r.take_profit) == (47500.0, None)
    fixed = S.stop_and_target(LIT("OPEN_LONG"), LIT(50000.0), LIT(1000.0), fixed_target=True, slippage_pct=0.10, fee_pct=0.05)
    assert one(spark, **fixed).take_profit == pytest.approx(51650.0)
    assert one(spark, **S.stop_and_target(LIT("OPEN_SHORT"), LIT(100.0), LIT(None).cast("double"))).stop_loss == pytest.approx(102.0)


def test_sizes(spark):
    size = lambda **k: one(spark, x=S.position_size(LIT(10000.0), LIT(50000.0), LIT(49000.0), **k)).x
    assert size(mode="percent_risk", risk_percent=1.0, leverage=1, max_usd=20000.0) == pytest.approx(0.1)
    assert size(mode="usd_fixed", fixed_usd=500.0) == pytest.approx(0.01)
    assert size(mode="usd_fixed", fixed_usd=500.0, max_usd=100.0) == pytest.approx(0.002)
    assert size(mode="unknown") == 0.0


def test_trigger(frame):
    positions = frame(
        [("p", "BTC", "long", 50000.0, 49000.0, 55000.0), ("q", "BTC", "short", 50000.0, 52000.0, 48000.0), ("r", "BTC", "long", 50000.0, 1.0, None)],
        "position_id string, token string, direction string, entry_price double, stop_loss double, take_profit double",
    ).withColumn("entry_ts", F.timestamp_seconds(LIT(0)))
    ticks = frame([("BTC", s, p, i) for i, (s, p) in enumerate([(0, 1.0), (1, 50500.0), (2, 48999.0), (3, 47000.0), (4, 60000.0)])], "token string, s long, price double, tick_id long")
    made = T.position_triggers(positions, ticks.withColumn("ts", F.timestamp_seconds("s"))).collect()
    assert {r.position_id: (r.reason, r.trigger_price) for r in made} == {"p": ("STOP_LOSS", 48999.0), "q": ("TAKE_PROFIT", 47000.0)}


def test_realised_pnl(frame):
    entries = frame([(1, "long", 25000.0, 0.1), (2, "SELL", 25000.0, 0.1), (3, "long", 1.0, 1.0)], "trade_id int, direction string, entry_price double, position_size double")
    exits = frame([(1, 26000.0, 3.5), (2, 26000.0, 3.5)], "trade_id int, exit_price double, fees double")
    got = {r.trade_id: (r.pnl_usd, r.status) for r in T.close_trades(entries, exits).collect()}
    assert got == {1: (96.5, "CLOSED"), 2: (-103.5, "CLOSED"), 3: (None, "OPEN")}


def test_trades_carry_their_exit(spark, frame):
    both = "trade_id int, direction string, entry_price double, position_size double, exit_price double, exit_at string, fees double"
    # trade 1 stands twice, 2 has no exit yet, 3 has no fees, 4 no exit price, 5 no id
    rows = [(1, "long", 10.0, 2.0, 15.0, "2024-01-01", 1.0)] * 2 + [
        (2, "long", 10.0, 2.0, 15.0, None, 1.0),
        (3, "Short", 10.0, 2.0, 15.0, "2024-01-02", None),
        (4, "long", 10.0, 2.0, None, "2024-01-02", 1.0),
        (None, "long", 10.0, None, 15.0, "2024-01-02", 1.0),
    ]
    trades = frame(rows, both).withColumn("exit_ts", F.col("exit_at").cast("timestamp")).drop("exit_at")
    made = T.close_trades(trades)
    assert [(r.trade_id, r.exit_price, r.fees, r.pnl_usd, r.status) for r in made.collect()] == [
        (1, 15.0, 1.0, 9.0, "CLOSED"),
        (1, 15.0, 1.0, 9.0, "CLOSED"),
        (2, None, None, None, "OPEN"),
        (3, 15.0, None, -10.0, "CLOSED"),
        (4, None, 1.0, None, "CLOSED"),
        (None, 15.0, 1.0, -1.0, "CLOSED"),
    ]
    # where ids are unique and given, matching separate exits comes to the same
    once = trades.dropDuplicates(["trade_id"]).filter("trade_id IS NOT NULL")
    cols = ["trade_id", "exit_ts", "exit_price", "fees", "pnl_usd", "status"]
    matched = T.close_trades(once.drop("exit_price", "exit_ts", "fees"), once.filter("exit_ts IS NOT NULL").select("trade_id", "exit_price", "exit_ts", "fees"))
    assert sorted(map(str, matched.select(cols).collect())) == sorted(map(str, T.close_trades(once).select(cols).collect()))


def test_close_trades_moves_the_lines_once(spark, tmp_path):
    """Lines that stand twice are two trades, as in SQL; only the orders are joined, so lines cross the network once."""
    import __spark_entry__ as entry
    from compare import differences, duck

    small = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{small}/lineitem.parquet").filter("l_orderkey < 50")
    lines.union(lines).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duck(small)
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    (tmp_path / "orders.parquet").symlink_to(f"{small}/orders.parquet")
    name, threshold = "close_trades", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        made = entry.queries()[name](spark, str(tmp_path))
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("FileScan") == 2
        got = made.toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(want) == 2 * lines.count() and differences(got, want) == []


def test_kpis(frame):
    df = frame([(100.0, 1.0, 10.0, 1.0), (200.0, 0.5, -15.0, 0.5), (50.0, 2.0, 8.0, 0.0)], "entry_price double, position_size double, pnl_usd double, fees double")
    k = T.trade_kpis(df).first()
    assert (k.total_trades, k.wins, k.losses) == (3, 2, 1)
    assert k.net_pl_usd == pytest.approx(1.5) and k.avg_pl_pct == pytest.approx(0.5)
    assert k.win_rate == pytest.approx(66.6667, abs=1e-3) and k.profit_factor == pytest.approx(17 / 15.5)
    assert T.trade_kpis(df.filter("pnl_usd > 0")).first().profit_factor == float("inf")
    assert T.trade_kpis(df.limit(0)).first().total_trades == 0


def test_retention(frame):
    rows = lambda xs, batch: frame([("k", x, batch) for x in xs], "key string, x int, batch int")
    keep = lambda n, mode="rolling_append": sorted(r.x for r in store.rolling_retention(rows([1, 2, 3], 0), rows([4, 5, 6, 7], 1), n, ["key"], ["batch", "x"], mode).collect())
    assert keep(5) == [3, 4, 5, 6, 7]
    assert keep(0) == []
    assert keep(5, "other") == [4, 5, 6, 7]


def test_upsert_is_change_only_and_idempotent(spark, frame, tmp_path):
    schema = "token string, ts long, close double, volume double, month string"
    target = frame([("a", 1, 1.0, 1.0, "m1"), ("b", 1, 2.0, None, "m1"), ("c", 1, 3.0, 1.0, "m2")], schema)
    batch = frame([("a", 1, 1.0, 1.0, "m1"), ("b", 1, 2.5, None, "m1"), ("d", 1, 4.0, 1.0, "m1")], schema)
    got = {r.token: r.action for r in store.upsert(target, batch, ["token", "ts"]).collect()}
    assert got == {"a": "unchanged", "b": "update", "c": "unchanged", "d": "insert"}
    path = str(tmp_path / "t")
    target.write.partitionBy("month").parquet(path)
    for _ in range(2):
        store.upsert_table(spark, path, batch, ["token", "ts"], "month")
        now = sorted((r.token, r.close) for r in spark.read.parquet(path).collect())
        assert now == [("a", 1.0), ("b", 2.5), ("c", 3.0), ("d", 4.0)]
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
    with pytest.raises(ValueError):
        store.upsert(target, batch, [])
    # duplicate keys need an order; with one the last of them wins, whatever its values
    twice = frame([("b", 1, 9.0, 1), ("b", 1, 2.0, 2)], "token string, ts long, close double, seq int")
    with pytest.raises(Exception, match="duplicate keys"):
        store.upsert(target, twice, ["token", "ts"]).collect()
    assert {r.token: r.close for r in store.upsert(target, twice, ["token", "ts"], ["seq"]).collect()}["b"] == 2.0
    plan = store.touched_partitions(spark.read.parquet(path), batch, "month")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [(month" in plan


def test_bar_table_round_trip_and_export(spark, frame, tmp_path):
    df = frame([("a", "1h", s, 1.0) for s in (1704067200, 1706745600)], "token string, tf string, s long, open double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    store.write_bars(df, str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    found = store.scan_bars(stored, ["a"], ["1h"], "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    assert found.count() == 1 and "PartitionFilters" in found._jdf.queryExecution().toString()
    store.write_csv(store.without_empty_columns(df.withColumn("none", F.lit(None).cast("int"))), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["token", "tf", "open", "ts"]
    store.write_labelled(df.withColumn("horizon", F.lit("4h")), str(tmp_path / "lab"))
    assert store.read_labelled(spark, str(tmp_path / "lab"), "4h").count() == 2


def test_payload_shapes(frame):
    quotes = {"data": {"BTC": [{"timestamp": "2024-01-01T00:00:00Z", "quote": {"USD": {"price": 1.5}}}], "ETH": {"quotes": [{"time": "1704067200", "market_cap": 9}]}, "X": 3}}
    got = P.flatten_quotes(frame([(json.dumps(quotes),)], "payload string")).orderBy("key").collect()
    assert [(r.key, r.price_usd, r.market_cap) for r in got] == [("BTC", 1.5, None), ("ETH", None, 9.0)]
    assert got[0].ts == got[1].ts
    fng = {"data": [{"timestamp": "1704067200", "value": 55}, {"date": "2024-01-02", "score": 1.0}]}
    assert [(r.value, r.score) for r in P.flatten_list(frame([(json.dumps(fng),)], "payload string")).orderBy("ts").collect()] == [(55.0, None), (None, 1.0)]
    cal = {"economicCalendar": [{"time": "2024-01-01 10:00:00", "impact": "high"}, {"impact": "low"}]}
    assert P.flatten_calendar(frame([(json.dumps(cal),)], "payload string")).count() == 1
    series = {"data": {"something": None, "other": {"timeseriesData": [{"datetime": "2024-01-01T00:00:00Z", "value": 3}]}}}
    assert [r.mvrv for r in P.flatten_metric(frame([(json.dumps(series),)], "payload string"), "mvrv").collect()] == [3.0]


def test_base_tokens(frame):
    rows = {"BINANCE_SPOT_BTC_USDT": "BTC", "A_B_C": "C", "A_B": None, "X_Y_Z_ETH_USD": "ETH"}
    got = {r.s: r.b for r in frame([(k,) for k in rows], "s string").select("s", P.base_token("s").alias("b")).collect()}
    assert got == rows

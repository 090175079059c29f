"""Registered queries that run as streams over the event files, and the model queries."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickloom.config import EVENT_FLAG, LABEL_HORIZONS, TIMEFRAMES
from tickloom.operators import labels as L, models as ML, scorer as SC
from tickloom.plans import bars_catalog as BC, features as feature_plan, trade_catalog
from tickloom.plans.sql import with_views
from tickloom.session import checkpoint, shared_dir
from tickloom.sources import payloads as P, views as V
from tickloom.sources.tables import out
from tickloom.streaming import market as R, positions as PM

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _ticks(spark, sf):
    # a glob reads the table whether it is one file or a folder of files
    raw = R.tick_stream(spark, f"{sf}/[e]vents.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)
    return raw.select(
        F.col("event_type").alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").alias("tick_id")
    )


def _run(spark, name, stream, mode="append"):
    """Drain a stream into its own folder and read back what it wrote."""
    folder = _folder(spark, name)
    schema = stream.schema
    R.start(stream, R.batch_folder_sink(f"{folder}/rows"), f"{folder}/state", mode).awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/rows")


CLOSED = "epoch_us({t}) + {s}::BIGINT * 1000000 <= (SELECT max(epoch_us(ts) // 1000 * 1000) FROM events) - {d}::BIGINT * 1000000"


@query(
    with_views("ticks")
    + """, b AS (SELECT token, time_bucket(INTERVAL '1 minute', ts) AS ts, arg_min(price, tick_id) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, tick_id) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2) SELECT * FROM b WHERE """
    + CLOSED.format(t="ts", s=60, d=60)
)
def stream_bars(spark, sf):
    made = _run(spark, "bars", R.stream_bars(_ticks(spark, sf)).drop("_w"))
    return out(made.drop("batch"))


@query(
    with_views("bars_1h", "bars_4h", "bars_1d", "bars_7d")
    + " UNION ALL ".join(
        f"SELECT token, '{tf}' AS tf, ts_ AS ts, open, high, low, close, volume FROM bars_{tf} WHERE " + CLOSED.format(t="ts_", s=TIMEFRAMES[tf], d=60) for tf in ("4h", "1d", "7d")
    )
)
def stream_resample(spark, sf):
    """Every coarser timeframe from one stream of hourly bars."""
    folder = _folder(spark, "resample")
    hourly = R.stream_bars(_ticks(spark, sf), 3600).drop("_w")
    R.start(hourly, R.cascade_sink(folder, ["4h", "1d", "7d"], 3600), f"{folder}/state").awaitTermination()
    return out(spark.read.parquet(f"{folder}/rows").drop("batch"))


def _late_ticks(spark, sf):
    """The ticks as files that arrive in five waves; every tenth tick comes with the last one, long after its bars closed."""
    folder = _folder(spark, "arrivals")
    ticks, files = V.ticks(spark, sf), spark.sparkContext.defaultParallelism
    last = ticks.agg(F.max("tick_id")).first()[0] or 0
    wave = F.when(F.col("tick_id") % 10 == 3, 4).otherwise(F.floor(F.col("tick_id") * 4 / (last + 1)).cast("int"))
    for k in range(5):
        ticks.filter(wave == k).repartition(files).write.mode("append").parquet(folder)
    return R.tick_stream(spark, folder, ticks.schema, files)


@query(
    with_views("ticks", "bars")
    + """SELECT token, '1m' AS tf, time_bucket(INTERVAL '1 minute', ts) AS ts, arg_min(price, tick_id) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, tick_id) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2, 3 UNION ALL SELECT * FROM bars"""
)
def stream_late_bars(spark, sf):
    """Bars of five timeframes from ticks of which a tenth is weeks late."""
    folder = _folder(spark, "late")
    R.start(_late_ticks(spark, sf), R.mergeable_sink(folder, ["1m", "1h", "4h", "1d", "7d"]), f"{folder}/state").awaitTermination()
    return out(R.stored_bars(spark, folder))


@query(f"WITH t AS ({trade_catalog.trade_ticks()}), b AS ({trade_catalog.trade_bars_sql(3600)}) SELECT * FROM b WHERE " + CLOSED.format(t="ts", s=3600, d=3600))
def stream_trade_bars(spark, sf):
    """Hourly bars of a stream of trade messages of two markets per token, some without a sequence."""
    raw = R.tick_stream(spark, f"{sf}/[e]vents.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)
    ticks = P.decode_trades(trade_catalog.trade_messages(raw.withColumn("ts", F.col("ts").cast("timestamp"))))
    return out(_run(spark, "trades", R.stream_bars(ticks, 3600, "1 hour").drop("_w")).drop("batch"))


@query(trade_catalog.ORACLES["position_triggers"])
def stream_triggers(spark, sf):
    """Ticks and positions arrive as two streams in two waves; the state of what is open outlives the query between them."""
    folder = _folder(spark, "triggers")
    ticks, positions = V.ticks(spark, sf), V.positions(spark, sf).withColumnRenamed("entry_ts", "ts")
    for late in (False, True):
        wave = (F.col("ts") >= F.lit("2024-01-15").cast("timestamp")) == F.lit(late)
        ticks.filter(wave).write.mode("append").parquet(f"{folder}/ticks")
        positions.filter(wave).write.mode("append").parquet(f"{folder}/changes")
        streams = (R.tick_stream(spark, f"{folder}/{name}", df.schema) for name, df in (("ticks", ticks), ("changes", positions)))
        PM.run_monitor(spark, PM.monitored(*streams, delay="60 days"), f"{folder}/hits", f"{folder}/state").awaitTermination()
    return out(spark.read.parquet(f"{folder}/hits"))


@query()
def stream_upsert(spark, sf):
    """Hourly bars of the stream merged into a stored table that lacks its newest days and
    holds stale volumes."""
    folder = _folder(spark, "upsert")
    stored = V.bars_1h(spark, sf).filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).withColumn("volume", F.lit(0.0))
    stored.withColumn("month", F.date_format("ts", "yyyy-MM")).write.partitionBy("month").parquet(f"{folder}/table")
    bars = R.stream_bars(_ticks(spark, sf), 3600).drop("_w").withColumn("month", F.date_format("ts", "yyyy-MM"))
    R.start(bars, R.upsert_sink(f"{folder}/table", ["token", "ts"], "month"), f"{folder}/state").awaitTermination()
    return out(spark.read.parquet(f"{folder}/table").drop("month"))


ORACLES["stream_upsert"] = (
    with_views("bars_1h")
    + f"SELECT token, ts, open, high, low, close, CASE WHEN {CLOSED.format(t='ts', s=3600, d=60)} THEN volume ELSE 0.0::DOUBLE END AS volume FROM bars_1h WHERE ts < TIMESTAMP '2024-01-20' OR "
    + CLOSED.format(t="ts", s=3600, d=60)
)


def _apart(views: dict[str, str], mark: str) -> dict[str, str]:
    """The same views under other names, so that two sets of them fit in one statement."""
    names = re.compile(rf"\b({'|'.join(views)})\b(?!\.)")
    return {mark + k: names.sub(rf"{mark}\1", v) for k, v in views.items()}


ATR_VIEWS = _apart({k: v for k, v in trade_catalog.TP_VIEWS.items() if k in ("src", "num", "stp", "run", "dxs", "adr", "ind", "known")}, "q_")


@query(
    with_views("bars", "econ_events", "bars_4h", recursive=True, extra={**BC.FT_VIEWS, **ATR_VIEWS})
    + ", f AS (SELECT token, ts, arg_min(rsi_15m, horizon) AS rsi FROM ft_wide WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in BC.FT_NUMBERS)
    + """ GROUP BY 1, 2), d AS (SELECT f.token, f.ts, CASE WHEN rsi > 50 THEN 'OPEN_LONG' ELSE 'OPEN_SHORT' END AS directive, b.close AS entry_price FROM f JOIN bars_1h b USING (token, ts)),
    j AS (SELECT d.*, k.atr, CASE WHEN k.atr > 0 THEN k.atr * 2.5 ELSE entry_price * 0.02::DOUBLE END AS dist FROM d ASOF LEFT JOIN q_known k ON k.token = d.token AND d.ts >= k.ts),
    p AS (SELECT *, CASE WHEN directive = 'OPEN_LONG' THEN greatest(0, entry_price - dist) ELSE entry_price + dist END AS stop_loss FROM j),
    z AS (SELECT *, least(20000, 10000.0::DOUBLE * 0.01::DOUBLE * entry_price * 5 / nullif(abs(entry_price - stop_loss), 0)) / entry_price AS size FROM p)
    SELECT token, ts, directive, entry_price, round(atr, 5) AS atr, round(stop_loss, 5) AS stop_loss, round(size, 5) AS size FROM z WHERE size > 0 AND """
    + CLOSED.format(t="ts", s=3600, d=60)
)
def live_signals(spark, sf):
    """Every closed bar of every drained batch runs the live cycle on the stored history."""
    folder = _folder(spark, "live")
    V.bars(spark, sf).write.parquet(f"{folder}/bars")
    label = F.when(F.col("rsi_15m") > 50, "OPEN_LONG").otherwise("OPEN_SHORT")

    def predict(features):
        return features.select("token", "ts", F.concat(F.lit("rule_"), "horizon").alias("model"), label.alias("label"), F.lit(0.9).alias("prob"))

    cycle = R.live_cycle(lambda s: s.read.parquet(f"{folder}/bars"), predict, R.batch_folder_sink(f"{folder}/signals"), 10000.0, V.WINDOWS, V.HORIZON_ROLES)
    bars = R.stream_bars(_ticks(spark, sf), 3600).drop("_w")
    R.start(bars, cycle, f"{folder}/state").awaitTermination()
    made = spark.read.parquet(f"{folder}/signals")
    return out(made.select("token", "ts", "directive", "entry_price", F.round("atr", 5).alias("atr"), F.round("stop_loss", 5).alias("stop_loss"), F.round("size", 5).alias("size")))


# ------------------------------------------------------------------ models


def _scores(spark, sf):
    """One model per horizon on all features and the event flag, every token and bar."""
    bars = V.bars(spark, sf)
    features = feature_plan.feature_table(bars, V.econ_events(spark, sf), V.ALL_WINDOWS, V.HORIZON_ROLES)
    labels = L.barrier_labels(V.bars_1h(spark, sf), LABEL_HORIZONS)
    whole = checkpoint(L.training_set(features, labels, list(LABEL_HORIZONS)).withColumn(EVENT_FLAG, F.col(EVENT_FLAG).cast("double")))
    made = [
        ML.train_and_score(whole.filter(F.col("horizon") == h).drop("horizon"), "target", [*BC.FEATURES, EVENT_FLAG], ["token"]).withColumn("horizon", F.lit(h))
        for h in LABEL_HORIZONS
    ]
    return reduce(DataFrame.unionByName, made)


@query()
def train_score(spark, sf):
    """Weighted multiclass fit on the train part, probabilities on the rest, for all horizons."""
    return out(_scores(spark, sf))


@query()
def model_metrics(spark, sf):
    return ML.score_metrics(_scores(spark, sf), ["horizon"])


# A linear model per horizon, as a user would bring one: class -> intercept and weights of a bar's return, range and volume.
CLASS_LABELS = {-1: "OPEN_SHORT", 0: "HOLD", 1: "OPEN_LONG"}
BAR_FEATURES = {"ret": "(close - open) / open", "span": "(high - low) / open", "lots": "ln(1 + volume)"}
LINEAR = {
    "1h": {-1: (0.1, -1.5, 0.2, 0.05), 0: (0.0, 0.0, -0.3, 0.1), 1: (0.1, 1.5, 0.2, 0.05)},
    "4h": {-1: (0.2, -0.75, 0.1, 0.02), 0: (0.3, 0.1, -0.1, 0.0), 1: (0.2, 0.75, 0.1, 0.02)},
    "1d": {-1: (0.0, -0.5, 0.0, 0.0), 0: (0.5, 0.0, 0.0, -0.01), 1: (0.0, 0.5, 0.0, 0.0)},
}
_Z = " UNION ALL ".join(
    f"SELECT token, tf, ts, '{CLASS_LABELS[c]}' AS label, {w[0]}::DOUBLE + {w[1]}::DOUBLE * ret + {w[2]}::DOUBLE * span + {w[3]}::DOUBLE * lots AS z FROM x WHERE tf = '{tf}'"
    for tf, classes in LINEAR.items()
    for c, w in classes.items()
)


@query(
    with_views("bars")
    + ", x AS (SELECT token, tf, ts, "
    + ", ".join(f"{e} AS {n}" for n, e in BAR_FEATURES.items())
    + f" FROM bars), z AS ({_Z}), "
    + """e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY token, tf, ts)) AS e FROM z), p AS (SELECT *, e / sum(e) OVER (PARTITION BY token, tf, ts) AS prob FROM e)
    SELECT token, ts, tf AS model, first_value(label) OVER (PARTITION BY token, tf, ts ORDER BY round(z, 9) DESC, CASE label WHEN 'OPEN_SHORT' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END) AS pred,
    label, round(prob, 9) AS prob FROM p"""
)
def user_model_scores(spark, sf):
    """Every bar of three timeframes scored by its timeframe's linear model."""
    features = V.bars(spark, sf).select("token", "tf", "ts", *[F.expr(e).alias(n) for n, e in BAR_FEATURES.items()])
    models = {
        tf: SC.LinearModel.of_rows([{"label": c, "feature": f, "weight": v} for c, w in classes.items() for f, v in zip((None, *BAR_FEATURES), w)]) for tf, classes in LINEAR.items()
    }
    made = SC.score_with(features, models, list(BAR_FEATURES), CLASS_LABELS, by="tf")
    return out(made.withColumn("prob", F.round("prob", 9)))

"""Weighted multiclass training and long-form scoring with MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tickloom.operators.dataset import chrono_split, class_metrics, decay_weights
from tickloom.session import checkpoint


def train(df: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str], weight: str | None = "weight", trees: int = 10, depth: int = 4, seed: int = 42):
    """Fit a forest on rows with a target; unseen categories keep an own slot."""
    ready = df.filter(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("string"))
    indexed = [f"_{c}_i" for c in categories]
    stages = [
        StringIndexer(inputCols=[*categories, "_y"], outputCols=[*indexed, "_label"], handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[*numbers, *indexed], outputCol="_x", handleInvalid="keep"),
        RandomForestClassifier(labelCol="_label", featuresCol="_x", numTrees=trees, maxDepth=depth, seed=seed, weightCol=weight),
    ]
    return Pipeline(stages=stages).fit(ready)


def score(model, df: DataFrame, keep: Sequence[str], target: str | None = None) -> DataFrame:
    """(keep..., pred, probas: map of label text -> probability)."""
    labels = list(model.stages[0].labelsArray[-1])
    ready = df.withColumn("_y", F.col(target).cast("string") if target else F.lit(labels[0]))
    scored = model.transform(ready).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(n) for n in labels])
    return scored.select(
        *keep,
        F.get(names, F.col("prediction").cast("int")).alias("pred"),
        F.map_from_arrays(names, F.slice("_p", 1, len(labels))).alias("probas"),
    )


def long_predictions(scored: DataFrame, keep: Sequence[str], model: str) -> DataFrame:
    return scored.select(*keep, F.lit(model).alias("model"), F.explode("probas").alias("label", "prob"))


def train_and_score(df: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Chronological split, decayed weights, fit on train, long probabilities on val and test.

    The prepared rows are written once: the split and the tree rounds read them many times.
    """
    split = checkpoint(decay_weights(chrono_split(df), F.col("split") == "train"))
    model = train(split.filter("split = 'train'"), target, numbers, categories)
    rest = score(model, split.filter("split <> 'train'"), ["token", "ts", "split", target], target)
    labels = long_predictions(rest.withColumnRenamed(target, "y"), ["token", "ts", "split", "y", "pred"], "forest")
    return labels.withColumn("prob", F.round("prob", 9))


def score_metrics(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log loss, accuracy and macro F1 per part from long predictions."""
    wide = long.groupBy("token", "ts", "split", *by).agg(
        F.first("y").cast("int").alias("y"),
        F.first("pred").try_cast("int").alias("pred"),
        F.map_from_entries(F.collect_list(F.struct(F.col("label").try_cast("int"), "prob"))).alias("probas"),
    )
    return class_metrics(wide, [-2, -1, 0, 1, 2], ["split", *by])

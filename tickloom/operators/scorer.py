"""Batch scoring with a user's model: any object with ``predict_proba`` or ``predict`` over a pandas frame."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class LinearModel:
    """Softmax of linear scores; ``weights`` has a row per class and a column per feature."""

    features: tuple[str, ...]
    classes: tuple
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    @classmethod
    def of_rows(cls, rows: Iterable[Mapping]) -> "LinearModel":
        """From (label, feature, weight) rows; the feature NULL holds the intercept, absent weights are 0."""
        held: dict = {}
        for row in rows:
            held.setdefault(row["label"], {})[row["feature"]] = float(row["weight"])
        classes = tuple(sorted(held))
        features = tuple(sorted({f for w in held.values() for f in w if f is not None}))
        return cls(features, classes, tuple(tuple(held[c].get(f, 0.0) for f in features) for c in classes), tuple(held[c].get(None, 0.0) for c in classes))

    def predict_proba(self, df: pd.DataFrame) -> np.ndarray:
        z = df[list(self.features)].to_numpy(np.float64) @ np.array(self.weights).reshape(len(self.classes), -1).T + np.array(self.intercepts)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _probabilities(model, df: pd.DataFrame, classes: Sequence) -> np.ndarray:
    """One row per row of ``df``, one column per class. A model that only predicts gives its class all weight."""
    made = model.predict_proba(df) if hasattr(model, "predict_proba") else model.predict(df)
    out = np.asarray(made)
    if out.ndim == 2 and out.shape[1] == 1 and len(classes) != 1:
        out = out[:, 0]
    if out.ndim == 1:
        out = (out[:, None] == np.array(classes, dtype=out.dtype if out.dtype.kind != "O" else object)[None, :]).astype(np.float64)
    if out.shape != (len(df), len(classes)):
        raise ValueError(f"the model made {out.shape} probabilities for {len(df)} rows of {len(classes)} classes")
    return out.astype(np.float64)


def score_with(
    df: DataFrame,
    models: Mapping[str, object],
    features: Sequence[str],
    labels: Mapping[object, str],
    keep: Sequence[str] = ("token", "ts"),
    by: str = "horizon",
    categories: Sequence[str] = (),
    rows: int = 20_000,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(keep..., model, pred, label, prob): a row per class of the model that the column ``by`` names.

    Models travel once to each executor, as bytes of a checked size, and are unpacked once per task. ``labels`` maps a
    model's classes to labels, in the order of its columns if it has no ``classes_`` or ``classes`` of its own. Features come as
    doubles (NULL as NaN), ``categories`` as text with NULL as "UNKNOWN"; one call sees at most ``rows`` rows. Rows whose ``by`` has no
    model are left out; rows of one class and probability tie towards the first class for ``pred``.
    """
    missing = [c for c in [*features, *categories, *keep, by] if c not in df.columns]
    if missing:
        raise KeyError(f"columns missing for the model: {missing}")
    packed = {name: cloudpickle.dumps(model) for name, model in models.items()}
    size = sum(map(len, packed.values()))
    if size > most_bytes:
        raise ValueError(f"the models take {size} bytes, more than {most_bytes}: raise most_bytes or score in several passes")
    held = df.sparkSession.sparkContext.broadcast(packed)
    named = list(labels.items())
    kept = df.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["model string", "pred string", "label string", "prob double"])
    wanted = df.where(F.col(by).isin(list(models))).select(
        *keep,
        F.col(by).cast("string").alias("_by"),
        F.struct(*[F.col(c).cast("double").alias(c) for c in features], *[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(c) for c in categories]).alias("_x"),
    )

    def classes_of(model) -> list:
        own = next((getattr(model, a) for a in ("classes_", "classes") if getattr(model, a, None) is not None), None)
        classes = [c.item() if hasattr(c, "item") else c for c in own] if own is not None else [c for c, _ in named]
        unknown = [c for c in classes if c not in labels]
        if unknown:
            raise KeyError(f"classes without a label: {unknown}")
        return classes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked: dict = {}
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                names = np.array(batch.column(batch.num_columns - 2).to_pylist(), dtype=object)
                x = pa.Table.from_struct_array(batch.column(batch.num_columns - 1)).to_pandas()
                for name in sorted(set(names)):
                    if name not in unpacked:
                        model = pickle.loads(held.value[name])
                        unpacked[name] = model, classes_of(model)
                    model, classes = unpacked[name]
                    at = np.flatnonzero(names == name)
                    p = _probabilities(model, x.iloc[at].reset_index(drop=True), classes)
                    texts = np.array([labels[c] for c in classes], dtype=object)
                    place = pa.array(np.repeat(at, len(classes)))
                    columns = [batch.column(k).take(place) for k in range(batch.num_columns - 2)]
                    best = texts[np.where(np.isnan(p), -1.0, p).argmax(axis=1)]
                    made = [np.full(len(place), name, object), np.repeat(best, len(classes)), np.tile(texts, len(at))]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, *(pa.array(c, pa.string()) for c in made), pa.array(p.reshape(-1))], [*batch.schema.names[:-2], "model", "pred", "label", "prob"]
                    )

    return wanted.mapInArrow(run, schema)

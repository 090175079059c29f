"""Batch scoring with models that a user brings."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tickloom.operators.scorer import LinearModel, score_with

ROWS = "token string, ts long, horizon string, a double, b double, kind string"
# the executors don't have this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])
LABELS = {0: "HOLD", 1: "OPEN_LONG"}


class Sums:
    """A model as libraries make them: classes of its own order, probabilities of a frame."""

    classes_ = np.array([1, 0])

    def predict_proba(self, df):
        assert list(df.columns) == ["a", "b", "kind"] and len(df) <= 3
        p = np.nan_to_num(df["a"].to_numpy()) / 10 + (df["kind"] == "x") * 0.5
        return np.stack([p, 1 - p], axis=1)


class Signs:
    def predict(self, df):
        return (df["a"] > 1).astype(int).to_numpy()


class Wrong:
    def predict_proba(self, df):
        return np.ones((len(df), 3))


@pytest.fixture
def rows(frame):
    return frame(
        [("t", i, "4h" if i % 2 else "1h", None if i == 3 else float(i % 5), 1.0, "x" if i < 5 else None) for i in range(11)] + [("t", 99, "8h", 1.0, 1.0, "x")], ROWS
    ).repartition(2)


def test_each_horizon_has_its_model(rows):
    got = score_with(rows, {"1h": Sums(), "4h": Signs()}, ["a", "b"], LABELS, categories=["kind"], rows=3).collect()
    by = {(r.ts, r.label): (r.model, r.pred, round(r.prob, 9)) for r in got}
    assert len(by) == len(got) == 22 and all(ts != 99 for ts, _ in by)
    assert by[4, "OPEN_LONG"] == ("1h", "OPEN_LONG", 0.9) and by[4, "HOLD"] == ("1h", "OPEN_LONG", 0.1)
    assert by[6, "OPEN_LONG"] == ("1h", "HOLD", 0.1)
    assert by[3, "OPEN_LONG"] == ("4h", "HOLD", 0.0) and by[3, "HOLD"] == ("4h", "HOLD", 1.0)  # NULL is NaN
    assert by[7, "OPEN_LONG"] == ("4h", "OPEN_LONG", 1.0)


def test_errors_name_what_is_wrong(rows):
    with pytest.raises(KeyError, match="nothing"):
        score_with(rows, {"1h": Sums()}, ["nothing"], LABELS)
    with pytest.raises(ValueError, match="more than 10"):
        score_with(rows, {"1h": Sums()}, ["a"], LABELS, most_bytes=10)
    with pytest.raises(Exception, match="3. probabilities for"):
        score_with(rows, {"1h": Wrong()}, ["a"], LABELS).collect()
    with pytest.raises(Exception, match="classes without a label"):
        score_with(rows, {"1h": Sums()}, ["a", "b"], {1: "OPEN_LONG"}, categories=["kind"]).collect()


def test_empty_table_gives_no_rows(rows):
    assert score_with(rows.limit(0), {"1h": Sums()}, ["a", "b"], LABELS, categories=["kind"]).collect() == []


def test_linear_model_of_rows():
    import pandas as pd

    model = LinearModel.of_rows([{"label": 1, "feature": "a", "weight": 2.0}, {"label": 0, "feature": None, "weight": 1.0}, {"label": 1, "feature": "b", "weight": -1.0}])
    p = model.predict_proba(pd.DataFrame({"b": [1.0, 0.0], "a": [1.0, 0.5]}))
    assert model.features == ("a", "b") and model.classes == (0, 1)
    assert p == pytest.approx(np.array([[0.5, 0.5], [0.5, 0.5]]))

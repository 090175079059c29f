"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert differences(got, con.execute(ORACLES[name]).df()) == []
    else:
        assert len(got) > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_label_horizon_is_trained_and_scored(spark):
    from tickloom.config import LABEL_HORIZONS

    scored = QUERIES["train_score"](spark, FOLDER).groupBy("horizon").count().collect()
    assert {r.horizon for r in scored} == set(LABEL_HORIZONS) and min(r["count"] for r in scored) > 0
    assert {r.horizon for r in QUERIES["model_metrics"](spark, FOLDER).select("horizon").distinct().collect()} == set(LABEL_HORIZONS)

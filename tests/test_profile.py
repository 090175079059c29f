"""Mergeable profiles and their drift."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import profile as P


@pytest.fixture
def rows(spark):
    return spark.range(3000).select((F.col("id") % 2).alias("k"), (F.sin(F.col("id")) * F.col("id")).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("b"), F.lit(None).cast("double").alias("none"))


def as_set(df):
    return sorted(map(repr, df.collect()))


def test_profiles_merge_to_the_whole(spark, rows, tmp_path):
    parts = [P.profile(rows.filter(f"pmod(hash(a), 3) = {i}"), ["a", "b", "none"], ["k"]) for i in range(3)]
    whole = P.profile(rows, ["a", "b", "none"], ["k"])
    assert as_set(P.merge_profiles(parts, ["k"])) == as_set(whole)
    for i, p in enumerate(parts):
        P.store_profile(p, str(tmp_path), str(i))
    P.store_profile(parts[2], str(tmp_path), "2")  # a repeated run counts once
    assert as_set(P.stored_profile(spark, str(tmp_path), by=["k"])) == as_set(whole)
    assert as_set(P.stored_profile(spark, str(tmp_path), ["1"], ["k"])) == as_set(parts[1])


def test_cells_are_ordered(frame):
    values = [-1e100, -5.0, -1e-9, 0.0, 0.3, 5.0, 1e100]
    got = [r.c for r in frame([(v,) for v in values], "v double").coalesce(1).select(P.cell(F.col("v")).alias("c")).collect()]
    assert got == [math.floor(math.asinh(v) * 16) for v in values] == sorted(got)
    odd = frame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(P.cell(F.col("v")).alias("c")).collect()
    assert {r.c for r in odd} == {None}


def test_drift_is_zero_for_the_same_rows_and_grows(rows):
    made = P.profile(rows, ["a", "b", "none"])
    same = {r.feature: r for r in P.drift(made, made).collect()}
    assert all(abs(r.psi) < 1e-12 and r.n_reference == r.n_current == 3000 for r in same.values())
    assert same["none"].missing_current == 3000 and same["none"].parts == 0 and same["b"].missing_reference == 600
    near = P.profile(rows.withColumn("a", F.col("a") * 1.1), ["a"])
    far = P.profile(rows.withColumn("a", F.col("a") * 10 + 500), ["a"])
    gone = P.profile(rows.withColumn("a", F.lit(None).cast("double")), ["a"])
    psi = [P.drift(P.profile(rows, ["a"]), x).first().psi for x in (near, far, gone)]
    assert 0 < psi[0] < psi[1] < psi[2]


def test_features_of_one_side_and_empty_tables(rows):
    made = {r.feature: r for r in P.drift(P.profile(rows, ["a"]), P.profile(rows, ["b"])).collect()}
    assert (made["a"].n_reference, made["a"].n_current, made["b"].n_reference, made["b"].n_current) == (3000, 0, 0, 3000)
    nothing = P.profile(rows.limit(0), ["a"])
    assert nothing.collect() == [] and P.drift(nothing, nothing).collect() == []

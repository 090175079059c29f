"""Readers. NTZ columns become UTC instants at the edge; scans stay columnar and prunable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from tickloom.session import prepare


def _recast(df: DataFrame, found: type, to: str) -> DataFrame:
    if not any(isinstance(f.dataType, found) for f in df.schema):
        return df
    return df.selectExpr(*[f"CAST(`{f.name}` AS {to}) AS `{f.name}`" if isinstance(f.dataType, found) else f"`{f.name}`" for f in df.schema])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return _recast(prepare(spark).read.parquet(f"{folder}/{name}.parquet"), T.TimestampNTZType, "TIMESTAMP")


def out(df: DataFrame) -> DataFrame:
    """Publish instants as zone-free UTC timestamps."""
    return _recast(df, T.TimestampType, "TIMESTAMP_NTZ")

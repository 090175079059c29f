"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fewest(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` distinct rows of ``columns``, those of smallest hash.

    Only hashes are ranked, and one number comes back: no task gets the texts of all others.
    """
    hashed = rows.select(*columns, F.xxhash64(*columns).alias("_h"))
    bound = hashed.select("_h").distinct().orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
    few = hashed.where(F.col("_h") <= bound) if bound is not None else hashed.limit(0)
    return few.dropDuplicates(["_h"]).drop("_h")

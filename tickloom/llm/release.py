"""Early release of shuffle files."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession


def release(spark: SparkSession) -> None:
    """Spark drops the shuffle files of plans that nobody holds any more when the driver collects its garbage.
    Called after a large intermediate result has been written, so that the disk holds one step at a time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

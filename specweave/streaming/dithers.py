"""An extension: observations that arrive as files keep a back-projection current.

The adjoint is a join with static weights and a sum by key, so that a
streaming aggregation over arriving slices gives what a batch over all of
them would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_adjoint(spark: SparkSession, path: str, schema: str, weights: DataFrame, on: list[str], to: list[str], value: str = "y") -> DataFrame:
    """A streaming frame of sums of weight times value by ``to``."""
    arriving = spark.readStream.schema(schema).parquet(path)
    return arriving.join(weights, on).groupBy(*to).agg(F.sum(F.col(value) * F.col("w")).alias("v"))

"""Simulated scenes: maps and templates brought to a model's grid, and its axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.operators import ordered


def centred(rows: DataFrame, axis: str, length: int, size: int) -> DataFrame:
    """The middle ``size`` samples of an axis, counted from 0; of an odd rest one more goes before."""
    first = max(0, -(-(length - size) // 2))
    inside = rows.where((F.col(axis) >= first) & (F.col(axis) < first + min(size, length)))
    return inside.withColumn(axis, (F.col(axis) - first).cast("int"))


def centred_axis(spark: SparkSession, n: int, step: float) -> DataFrame:
    """(idx, x): n samples around 0."""
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), ((F.col("id") - (n - 1) / 2.0) * step).alias("x"))


def scene(maps: DataFrame, templates: DataFrame, rows: int, columns: int, every: int = 4, size: int | None = None, along: int = 3) -> tuple[DataFrame, DataFrame]:
    """Maps (m, i, j, a) averaged over ``every`` pixels a side and cut to ``size``, and templates (m, l, t) over ``along`` samples.

    Averages take every ``every``-th of the windows that end there, with
    zeros before the edge, and every ``along``-th of the centred ones.
    """
    small = ordered.box_mean_2d(maps.withColumnRenamed("m", "l"), every, "a").withColumnRenamed("l", "m").withColumnRenamed("mean", "a")
    small = small.where((F.col("i") * every < rows) & (F.col("j") * every < columns))
    n, k = -(-rows // every), -(-columns // every)
    if size is not None:
        small = centred(centred(small, "i", n, size), "j", k, size)
    return small, ordered.box_mean_decimate(templates, "m", "l", "t", along).withColumnRenamed("mean", "t")

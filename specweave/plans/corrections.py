"""Distortion correction: detector samples onto a regular grid of each slit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.operators import neighbours, selection


def corrected_slices(samples: DataFrame, axis: DataFrame, alphas: int, high: float | None, low: float | None = None, cutoff: float = 2.0) -> DataFrame:
    """Slices (s, lp, a, v) from samples (label, x, alpha, v), x the wavelength.

    A slit with a wavelength beyond ``high`` or below ``low`` goes; the rest
    are numbered densely by label, label 0 being background. Each gets a grid of
    ``alphas`` even positions between its own extremes and the wavelengths
    of ``axis`` (idx, x), filled by modified-Shepard means of the samples
    within ``cutoff`` grid cells; null and NaN samples shape the extremes and
    take no part in the means. Values without a near sample are 0.
    """
    seen = samples.where("label <> 0")
    if high is not None or low is not None:
        seen = selection.reject_out_of_range(seen, float("inf") if high is None else high, low)
    extent = seen.groupBy("label").agg(F.min("alpha").alias("a0"), F.max("alpha").alias("a1"))
    extent = extent.withColumn("s", F.row_number().over(Window.orderBy("label")) - 1)
    ends = axis.agg((F.max("x") - F.min("x")).alias("_span"), F.min("x").alias("x0"), F.count("*").alias("_n"))
    grid = extent.crossJoin(F.broadcast(ends)).select("label", "s", "a0", "x0", ((F.col("a1") - F.col("a0")) / (alphas - 1 if alphas > 1 else 1)).alias("da"), ((F.col("a1") - F.col("a0")) / alphas).alias("ra"), (F.col("_span") / F.col("_n")).alias("rx"))
    # Slits lie far apart on a common plane, so that one bucketed join serves them all.
    apart = F.col("s") * (alphas + 8.0 * cutoff + 8)
    scaled = lambda v, origin, size: F.coalesce(F.try_divide(F.col(v) - F.col(origin), F.col(size)), F.lit(0.0))
    knots = grid.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(alphas - 1)))).withColumn("alpha", F.col("a0") + F.col("a") * F.col("da"))
    knots = knots.crossJoin(axis.select(F.col("idx").alias("lp"), "x"))
    targets = knots.select(F.struct("s", "lp", "a").alias("t"), (scaled("alpha", "a0", "ra") + apart).alias("x"), scaled("x", "x0", "rx").alias("y"))
    valid = seen.where("v is not null and not isnan(v)").join(grid, "label")
    placed = valid.select((scaled("alpha", "a0", "ra") + apart).alias("sx"), scaled("x", "x0", "rx").alias("sy"), F.col("v").cast("double").alias("v"))
    return neighbours.shepard(targets, placed, cutoff).select("t.s", "t.lp", "t.a", "v")

"""Image quality and summary statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    return x.select(*on, F.col("v").cast("double").alias("x")).join(y.select(*on, F.col("v").cast("double").alias("y")), on)


def mean_square_error(p: DataFrame) -> DataFrame:
    return p.agg(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("mse"))


def relative_error(p: DataFrame) -> DataFrame:
    """Squared error over squared norm of x, in per cent; null where x is 0."""
    return p.agg(F.try_divide(100 * F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))), F.sum(F.col("x") * F.col("x"))).alias("relative_error"))


def psnr(p: DataFrame) -> DataFrame:
    """Peak signal to noise ratio over the range of x; infinite without error."""
    s = p.agg(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("mse"), (F.max("x") - F.min("x")).alias("span"))
    return s.select(F.when(F.col("mse") == 0, F.lit(math.inf)).otherwise(20 * F.log10(F.col("span") / F.sqrt("mse"))).alias("psnr"))


def spectral_angle(p: DataFrame) -> DataFrame:
    """One angle between the whole vectors; 0 if either has no length."""
    s = p.agg(F.sum(F.col("x") * F.col("y")).alias("d"), (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("n"))
    return s.select(F.when(F.col("n") == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("d", "n"))))).alias("sam"))


def signal_to_noise(p: DataFrame) -> DataFrame:
    """Signal to noise in decibels; infinite without error, null where both are 0."""
    s = p.agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("e"))
    return s.select(F.when((F.col("e") == 0) & (F.col("s") > 0), F.lit(math.inf)).otherwise(10 * F.log10(F.try_divide("s", "e"))).alias("snr"))


def structural_similarity(p: DataFrame, window: int = 7, span: float = 1.0) -> DataFrame:
    """Mean SSIM of planes over uniform windows of ``window`` cells a side."""
    half = window // 2
    near = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    spread = p.withColumn("a", near).withColumn("b", near)
    edge = p.groupBy("l").agg(F.max("i").alias("ni"), F.max("j").alias("nj"))
    m = spread.groupBy("l", (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).agg(*[F.avg(e).alias(n) for n, e in (("mx", F.col("x")), ("my", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))], F.count("*").alias("n")).where(F.col("n") == window * window)
    grow, c1, c2 = window * window / (window * window - 1), (0.01 * span) ** 2, (0.03 * span) ** 2
    vx, vy, vxy = (grow * (F.col(a) - F.col(b) * F.col(c)) for a, b, c in (("xx", "mx", "mx"), ("yy", "my", "my"), ("xy", "mx", "my")))
    s = (2 * F.col("mx") * F.col("my") + c1) * (2 * vxy + c2) / ((F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + c1) * (vx + vy + c2))
    return m.join(edge, "l").agg(F.avg(s).alias("ssim"))


def nonzero_mean(cube: DataFrame, value: str = "v") -> DataFrame:
    """Mean of the values other than 0 in each plane; 0 if there are none."""
    return cube.groupBy("l").agg(F.coalesce(F.avg(F.nullif(F.col(value), F.lit(0))), F.lit(0.0)).alias("mean"))


def mean_spectrum(cube: DataFrame, value: str = "v") -> DataFrame:
    """Mean of each plane, over the values that aren't NaN or null."""
    return cube.groupBy("l").agg(F.avg(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).alias("mean"))


def gray(cube: DataFrame, value: str = "v") -> DataFrame:
    """Planes 0, 1 and 2 (red, green, blue) as one; fixed weights of the luminance."""
    weight = F.element_at(F.array(F.lit(0.2125), F.lit(0.7154), F.lit(0.0721)), F.col("l") + 1)
    return cube.where("l < 3").groupBy("i", "j").agg(F.sum(F.col(value) * weight).alias("v"))


def frobenius(p: DataFrame) -> DataFrame:
    """Norm of the difference, and mean relative error where x isn't 0."""
    d = F.col("x") - F.col("y")
    return p.agg(F.sqrt(F.sum(d * d)).alias("norm"), F.avg(F.abs(F.try_divide(d, F.col("x")))).alias("relative"))


def coverage_mean(parts: DataFrame, least: float, value: str = "v") -> DataFrame:
    """Sum over pointings divided by how many exceed a threshold; 0 if none."""
    return parts.groupBy("i", "j").agg(F.coalesce(F.try_divide(F.sum(value).cast("double"), F.count_if(F.col(value) > least).cast("double")), F.lit(0.0)).alias("v"))


def centroids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"), F.count("*").alias("n"))


def relative_extremum(p: DataFrame) -> DataFrame:
    """Difference of the largest values in per cent of x's; null where that is 0."""
    return p.agg((F.try_divide(F.max("x") - F.max("y"), F.max("x")) * 100).alias("error"))

"""Masks, regions and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_of_view(cube: DataFrame, least: float, value: str = "v") -> DataFrame:
    """Pixels of which some plane reaches ``least`` and isn't 0."""
    return cube.groupBy("i", "j").agg(F.bool_or((F.col(value) >= least) & (F.col(value) != 0)).alias("inside")).where("inside").select("i", "j")


def apply_mask(cube: DataFrame, mask: DataFrame, value: str = "v") -> DataFrame:
    """The cube with 0 outside the mask."""
    return cube.join(mask.withColumn("_in", F.lit(True)), ["i", "j"], "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(F.lit(0))).drop("_in")


def dilate(mask: DataFrame, rows: int, columns: int) -> DataFrame:
    """A mask with its eight neighbours, off the outermost pixels."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    moved = mask.select("i", "j", near.alias("d")).select((F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"))
    return moved.where((F.col("i") > 0) & (F.col("i") < rows - 1) & (F.col("j") > 0) & (F.col("j") < columns - 1)).distinct()


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a ray from the point crosses the outline an odd number of times."""
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ya == yb:
            continue
        straddles = (F.lit(ya) > y) != (F.lit(yb) > y)
        crossings = crossings + F.when(straddles & (x < (xb - xa) * (y - ya) / (yb - ya) + xa), 1).otherwise(0)
    return crossings % 2 == 1


def open_window(cube: DataFrame, low: float, high: float, axis: str = "x") -> DataFrame:
    """Samples strictly between the bounds, but for the last of them."""
    inside = cube.where((F.col(axis) > low) & (F.col(axis) < high))
    last = inside.agg(F.max(axis).alias("_last"))
    return inside.join(F.broadcast(last), F.col(axis) < F.col("_last")).drop("_last")


def reject_out_of_range(samples: DataFrame, high: float, low: float | None = None) -> DataFrame:
    """Samples of the labels that never go beyond a bound."""
    beyond = samples.where(F.col("x") > high) if low is None else samples.where(F.col("x") < low)
    return samples.join(beyond.select("label").distinct(), "label", "left_anti")


def by_channel(cube: DataFrame, cuts: DataFrame, kept: list[int], value: str = "v") -> DataFrame:
    """The cube with each wavelength's channel, counted from 1 over the cuts (idx), and 0 in channels that aren't ``kept``."""
    packed = cuts.agg(F.collect_list("idx").alias("_cuts"))
    chan = (F.size(F.filter("_cuts", lambda c: c <= F.col("l"))) + 1).cast("int")
    named = cube.join(packed, F.lit(True)).withColumn("chan", chan).drop("_cuts")
    return named.withColumn(value, F.when(F.col("chan").isin(kept), F.col(value)).otherwise(F.lit(0)))


def trim_empty_planes(cube: DataFrame, value: str = "v") -> DataFrame:
    """Planes from the first to before the last whose sum isn't 0."""
    full = cube.groupBy("l").agg(F.sum(value).alias("s")).where("s <> 0").agg(F.min("l").alias("_a"), F.max("l").alias("_b"))
    return cube.join(F.broadcast(full), (F.col("l") >= F.col("_a")) & (F.col("l") < F.col("_b"))).drop("_a", "_b")


def keep_voxels(cube: DataFrame, chosen: DataFrame, removed: bool = False) -> DataFrame:
    return cube.join(chosen, ["l", "i", "j"], "left_anti" if removed else "left_semi")


def clean(value: Column) -> Column:
    """NaN, null and negative values as 0."""
    return F.when(value.isNull() | F.isnan(value) | (value < 0), F.lit(0.0)).otherwise(value)

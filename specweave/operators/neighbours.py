"""Nearest samples, scattered interpolation and fills, by grid buckets.

A search radius becomes an equi-join on cells of that size: each sample goes
to the nine cells around its own, so that no pair beyond them is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.runtime import materialize


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def within_radius(targets: DataFrame, samples: DataFrame, radius: float) -> DataFrame:
    """Pairs of target (t, x, y) and sample (id, sx, sy, v) at most ``radius`` apart, with ``d``."""
    here = targets.withColumn("cx", _cell("x", radius)).withColumn("cy", _cell("y", radius))
    offset = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = samples.withColumn("o", offset).withColumn("cx", _cell("sx", radius) + F.col("o.a")).withColumn("cy", _cell("sy", radius) + F.col("o.b")).drop("o")
    d = F.sqrt((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")))
    return here.join(near, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).drop("cx", "cy")


def shepard(targets: DataFrame, samples: DataFrame, cutoff: float = 1.0, power: float = 2.0, sharpness: float = 2.0, scale: float = 1.0) -> DataFrame:
    """Exponential modified-Shepard interpolation; 0 where no sample is near."""
    squeezed = lambda df, a, b: df.withColumn(a, F.col(a) / scale).withColumn(b, F.col(b) / scale)
    near = within_radius(squeezed(targets, "x", "y"), squeezed(samples, "sx", "sy"), cutoff).withColumn("d", F.col("d") + 1e-6).where(F.col("d") <= cutoff)
    w = F.exp(-sharpness * F.pow("d", F.lit(power)))
    found = near.groupBy("t").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))
    return targets.select("t").join(found, "t", "left").select("t", F.coalesce("v", F.lit(0.0)).alias("v"))


def nearest_on_axis(values: DataFrame, axis: DataFrame) -> DataFrame:
    """The index of the sample nearest to each value; the lowest of several.

    The intervals between samples of ``axis`` (idx, x) go to buckets of the
    axis's mean step, so that a value meets those of its bucket only and is
    in one of them; the nearer end of that is its sample. A null value gets
    none.
    """
    ends = axis.agg(F.min("x").alias("x0"), F.max("x").alias("xn"), F.count("*").alias("n")).first()
    if not ends.n:
        return values.select("t", F.lit(None).cast("int").alias("idx"))
    step = (ends.xn - ends.x0) / max(1, ends.n - 1) or 1.0
    bucket = lambda x: F.greatest(F.lit(-1), F.least(F.lit(ends.n), F.floor((x - ends.x0) / step))).cast("long")
    distinct = axis.groupBy("x").agg(F.min("idx").alias("idx"))
    order = Window.orderBy("x")
    inner = distinct.select(F.col("x").alias("lo"), F.col("idx").alias("lo_idx"), F.lead("x").over(order).alias("hi"), F.lead("idx").over(order).alias("hi_idx"))
    first = distinct.orderBy("x").limit(1).select(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("int").alias("lo_idx"), F.col("x").alias("hi"), F.col("idx").alias("hi_idx"))
    pieces = inner.unionByName(first).select("*", F.explode(F.sequence(F.when(F.col("lo").isNull(), F.lit(-1).cast("long")).otherwise(bucket(F.col("lo"))), F.when(F.col("hi").isNull(), F.lit(ends.n).cast("long")).otherwise(bucket(F.col("hi"))))).alias("_bucket"))
    inside = (F.col("lo").isNull() | (F.col("x") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi")))
    low, high = F.col("x") - F.col("lo"), F.col("hi") - F.col("x")
    nearer = F.when(F.col("hi").isNull() | (low < high) | ((low == high) & (F.col("lo_idx") < F.col("hi_idx"))), F.col("lo_idx")).otherwise(F.col("hi_idx"))
    found = values.withColumn("_bucket", bucket(F.col("x"))).join(pieces, "_bucket").where(inside)
    known = found.select("t", nearer.cast("int").alias("idx"))
    return known.unionByName(values.where("x is null").select("t", F.lit(None).cast("int").alias("idx")))


def nearest_sample(targets: DataFrame, samples: DataFrame, radius: float) -> DataFrame:
    """(t, id): the sample (id, sx, sy) nearest to each target (t, x, y), the lowest id of several.

    Rings of growing radius are searched, so that the cost follows how far
    the samples are. Distances that agree to nine decimals of their square
    count as equal. Without samples no target has one.
    """
    samples, n = materialize(samples.select("id", "sx", "sy"), "samples", counted=True)
    left, done = targets.select("t", "x", "y"), None
    while n:
        near = within_radius(left, samples, float(radius)).groupBy("t").agg(F.min_by("id", F.struct(F.round(F.col("d") * F.col("d"), 9), "id")).alias("id"))
        found = materialize(near, "nearest")
        done = found if done is None else done.unionByName(found)
        left, n = materialize(left.join(found, "t", "left_anti"), "left", counted=True)
        radius *= 4
    return done if done is not None else targets.select("t", F.lit(None).cast("long").alias("id")).limit(0)


def nearest_fill(grid: DataFrame, radius: int) -> DataFrame:
    """Null cells of (i, j, v) take the value of the nearest full cell.

    Rings of growing radius are searched, so that the cost follows the size
    of the holes; ties go to the lowest (i, j). A grid without a full cell
    stays as it is.
    """
    full = grid.where("v is not null").select(F.xxhash64("i", "j").alias("id"), F.col("i").cast("double").alias("sx"), F.col("j").cast("double").alias("sy"), F.col("i").alias("fi"), F.col("j").alias("fj"), "v").persist()
    holes = grid.where("v is null").select(F.struct("i", "j").alias("t"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    done = None
    if not full.isEmpty():
        while not holes.isEmpty():
            found = within_radius(holes, full, float(radius)).groupBy("t").agg(F.min_by("v", F.struct("d", "fi", "fj")).alias("v"))
            done = found if done is None else done.union(found)
            holes = holes.join(found, "t", "left_anti")
            radius *= 4
    filled = grid.where("v is not null").select("i", "j", "v")
    return filled if done is None and holes.isEmpty() else filled.union(grid.where("v is null").select("i", "j", "v")) if done is None else filled.union(done.select("t.i", "t.j", "v"))


def label_components(mask: DataFrame, columns: int) -> DataFrame:
    """Eight-neighbour components of a mask, named by their smallest pixel number."""
    from specweave.operators.components import connected_components

    pixels = mask.select((F.col("i") * columns + F.col("j")).cast("long").alias("p"), "i", "j")
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = pixels.withColumn("d", ahead).select(F.col("p").alias("a"), (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"))
    edges = moved.join(pixels.withColumnRenamed("p", "b"), ["i", "j"]).select("a", "b")
    found = connected_components(edges)
    return pixels.join(found, pixels.p == found.node, "left").select("i", "j", F.coalesce("component", "p").alias("label"))


def sort_labels(labelled: DataFrame) -> DataFrame:
    """Labels renumbered from 1 by the column of their centroid, ties by label."""
    from pyspark.sql import Window

    order = labelled.groupBy("label").agg(F.avg("j").alias("cj")).withColumn("rank", F.row_number().over(Window.orderBy("cj", "label")))
    return labelled.join(order.select("label", "rank"), "label").select("i", "j", F.col("rank").alias("label"))


def line_profile(cube: DataFrame, start: tuple[float, float], stop: tuple[float, float], rows: int, columns: int, points: int = 1000, value: str = "v") -> DataFrame:
    """Bilinear samples along a line, over the largest of them in each plane."""
    from pyspark.sql import Window

    from specweave.operators.linear import bilinear_weights, grid_forward

    at = lambda a, b: F.lit(float(a)) + F.col("id") * ((b - a) / (points - 1))
    targets = cube.sparkSession.range(points).select(F.col("id").cast("int").alias("t"), at(start[0], stop[0]).alias("x"), at(start[1], stop[1]).alias("y"))
    found = grid_forward(cube, bilinear_weights(targets, 0.0, 1.0, rows, 0.0, 1.0, columns), value)
    return found.select("l", "t", F.try_divide(F.col("v").cast("double"), F.max("v").over(Window.partitionBy("l")).cast("double")).alias("v"))


def rotate_cube(cube: DataFrame, degrees: float, rows: int, columns: int) -> DataFrame:
    """Planes turned about their centre by bilinear interpolation; 0 from outside."""
    from specweave.operators.linear import bilinear_weights, grid_forward

    spark, a = cube.sparkSession, F.radians(F.lit(float(degrees)))
    pixels = spark.range(rows * columns).select(F.col("id").cast("int").alias("t"))
    ci, cj = (rows - 1) / 2, (columns - 1) / 2
    di, dj = F.expr(f"t div {columns}") - ci, F.col("t") % columns - cj
    targets = pixels.select("t", (F.cos(a) * di + F.sin(a) * dj + ci).alias("x"), (F.cos(a) * dj - F.sin(a) * di + cj).alias("y"))
    turned = grid_forward(cube, bilinear_weights(targets, 0.0, 1.0, rows, 0.0, 1.0, columns, "zero"))
    return turned.select("l", F.expr(f"t div {columns}").cast("int").alias("i"), (F.col("t") % columns).cast("int").alias("j"), "v")

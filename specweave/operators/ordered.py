"""Operators along an ordered axis: median and mean filters, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.runtime import materialize


def spectral_median(pixels: DataFrame, size: int) -> DataFrame:
    """Median of ``size`` samples (odd) along each spectrum; edges mirror, edge sample repeated."""
    half = size // 2
    s = F.col("spectrum")
    head = F.reverse(F.slice(s, 1, half))
    tail = F.reverse(F.slice(s, F.size(s) - half + 1, half))
    padded = pixels.withColumn("_pad", F.concat(head, s, tail))
    median = F.transform(F.sequence(F.lit(1), F.size(s)), lambda k: F.array_sort(F.slice(F.col("_pad"), k, size))[half])
    return padded.withColumn("spectrum", median).drop("_pad")


def box_mean_decimate(rows: DataFrame, key: str, order: str, value: str, width: int = 3) -> DataFrame:
    """Centred moving mean with zeros beyond the ends, then every ``width``-th sample."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return rows.withColumn("mean", F.sum(value).over(w) / width).where(F.col(order) % width == 0).select(key, (F.expr(f"{order} div {width}")).cast("int").alias(order), "mean")


def box_mean_2d(plane: DataFrame, k: int, value: str = "v") -> DataFrame:
    """Mean of the k x k cells that end at every k-th one; zeros before the edge."""
    spread = plane.select("l", "i", "j", F.col(value).alias("_v"), F.explode(F.array(F.ceil(F.col("i") / k) * k)).alias("bi")).withColumn("bj", F.ceil(F.col("j") / k) * k)
    return spread.groupBy("l", F.expr(f"bi div {k}").cast("int").alias("i"), F.expr(f"bj div {k}").cast("int").alias("j")).agg((F.sum("_v") / (k * k)).alias("mean"))


def resample_linear(pixels: DataFrame, samples: int) -> DataFrame:
    """Each spectrum at ``samples`` points spread evenly over its axis."""
    s = F.col("spectrum")
    n = F.size(s)

    def at(k):
        u = k * (n - 1) / F.lit(float(samples - 1))
        lo = F.least(F.floor(u).cast("int"), n - 2)
        return s[lo] + (u - lo) * (s[lo + 1] - s[lo])

    return pixels.withColumn("spectrum", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), at))


def stride(rows: DataFrame, axis: str, step: int) -> DataFrame:
    return rows.where(F.col(axis) % step == 0).withColumn(axis, F.expr(f"{axis} div {step}").cast("int"))


def rolled(rows: DataFrame, key: str, axis: str, by: dict[int, int], n: int) -> DataFrame:
    """Each key's samples moved round by its own number of places, 0 where it has none."""
    places = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in by.items() for x in pair]), F.col(key)), F.lit(0))
    return rows.withColumn(axis, F.pmod(F.col(axis) + places, F.lit(n)).cast("int"))


def stuffed(rows: DataFrame, key: str, axis: str, value: str, factor: int) -> DataFrame:
    """Samples with ``factor`` - 1 zeros after each, then the centred box sum over ``factor`` places."""
    wide = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    wide = wide.select(key, (F.col(axis) * factor + F.col("_k")).cast("int").alias(axis), F.when(F.col("_k") == 0, F.col(value)).otherwise(F.lit(0)).alias(value))
    near = Window.partitionBy(key).orderBy(axis).rowsBetween(-(factor // 2), factor // 2)
    return wide.withColumn(value, F.sum(value).over(near))


def upsample(rows: DataFrame, axis: str, factor: int) -> DataFrame:
    """Each sample ``factor`` times, side by side."""
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(axis, F.col(axis) * factor + F.col("_k")).drop("_k")


def thin(rows: DataFrame, keys: list[str], keep_of: int, seed: int = 1) -> DataFrame:
    """A seeded thinning: one row in ``keep_of``, by the first 15 hex digits of an MD5 of its keys."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *keys).cast("binary"))
    return rows.where(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % keep_of == 0)


def reverse_blocks(rows: DataFrame, axis: str, size: int, blocks: int) -> DataFrame:
    """Blocks of ``size`` samples in reverse order, each as it is."""
    k = F.col(axis)
    return rows.withColumn(axis, ((blocks - 1 - F.floor(k / size)) * size + k % size).cast("int"))


def side_by_side(parts: list[tuple[DataFrame, int]], axis: str) -> DataFrame:
    """Tables joined along an axis, each shifted by the lengths of those before it."""
    out, start = None, 0
    for part, length in parts:
        moved = part.withColumn(axis, (F.col(axis) + start).cast("int"))
        out = moved if out is None else out.unionByName(moved)
        start += length
    return out


def into_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pixels (i, j) as blocks of ``size`` a side: the block's place (bi, bj), and i and j within it."""
    return rows.withColumns({"bi": F.floor(F.col("i") / size).cast("int"), "bj": F.floor(F.col("j") / size).cast("int"), "i": (F.col("i") % size).cast("int"), "j": (F.col("j") % size).cast("int")})


def from_blocks(blocks: DataFrame, size: int) -> DataFrame:
    return blocks.withColumns({"i": (F.col("bi") * size + F.col("i")).cast("int"), "j": (F.col("bj") * size + F.col("j")).cast("int")}).drop("bi", "bj")


def ranked(rows: DataFrame, by: list[Column], name: str = "r") -> DataFrame:
    """The rows with their place from 1 in the order of ``by``, in two levels.

    The rows are cut into ranges by a sample of the whole order, so that
    ties spread as well; each range counts its own, and running sums over
    the few ranges give where it starts.
    """
    keyed = rows.withColumn("_by", F.struct(*by))
    cut = materialize(keyed.repartitionByRange(F.col("_by")).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_by"))
    return cut.withColumn("_own", own).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_own")).select(*rows.columns, name)


def running_offsets(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Where each block of a concatenation starts; one row a block."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def extend_axis(axis: DataFrame, samples: int = 10, times: int = 10) -> DataFrame:
    """An axis (array x) with more samples on either side, at ``times`` the edge steps."""
    x = F.col("x")
    first, last = (x[1] - x[0]) * times, (F.element_at(x, -1) - F.element_at(x, -2)) * times
    before = F.transform(F.sequence(F.lit(samples), F.lit(1), F.lit(-1)), lambda k: x[0] - k * first)
    after = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda k: F.element_at(x, -1) + k * last)
    return axis.withColumn("x", F.concat(before, x, after))

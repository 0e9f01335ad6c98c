"""Linear operators as weight relations, and their exact adjoints.

``forward`` joins a vector with the weights on the input key and sums by the
output key; ``adjoint`` is the same join with the keys swapped, so that the
dot-product identity holds by construction. Weights are geometry: they grow
with the instrument and not with the observations, and the planner
broadcasts them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.schema import GridSpec


def apply_weights(vector: DataFrame, weights: DataFrame, on: list[str], to: list[str], value: str = "v", weight: str = "w", result: str = "v") -> DataFrame:
    """Sum of weight times value over ``on``, for each key of ``to``."""
    joined = vector.withColumnRenamed(value, "_value").join(weights.withColumnRenamed(weight, "_weight"), on)
    return joined.groupBy(*to).agg(F.sum(F.col("_value") * F.col("_weight")).alias(result))


def mix_maps(maps: DataFrame, templates: DataFrame) -> DataFrame:
    """Abundance maps (m, i, j, a) and templates (m, l, t) to a cube."""
    return apply_weights(maps, templates, ["m"], ["l", "i", "j"], "a", "t")


def unmix_cube(cube: DataFrame, templates: DataFrame, value: str = "v") -> DataFrame:
    """The adjoint of ``mix_maps``: a cube to maps."""
    return apply_weights(cube, templates, ["l"], ["m", "i", "j"], value, "t", "a")


def template_gram(templates: DataFrame) -> DataFrame:
    """(m, n, g): the products of the templates, with which ``unmix_cube`` after ``mix_maps`` needs no cube."""
    other = templates.select(F.col("m").alias("n"), "l", F.col("t").alias("_t"))
    return templates.join(other, "l").groupBy("m", "n").agg(F.sum(F.col("t") * F.col("_t")).alias("g"))


def mix_and_unmix(maps: DataFrame, gram: DataFrame) -> DataFrame:
    """The adjoint of mixing after mixing: maps (m, i, j, v) to the terms of maps, which add up by (m, i, j)."""
    return maps.join(gram, "m").select(F.col("n").alias("m"), "i", "j", (F.col("v") * F.col("g")).alias("v"))


def circular_blur(cube: DataFrame, psf: DataFrame, grid: GridSpec, value: str = "v", transposed: bool = False) -> DataFrame:
    """Circular convolution of each plane with the offsets (di, dj, w).

    Every value goes to the few places that the kernel reaches. The adjoint
    turns the offsets round.
    """
    return circular_terms(cube, psf, grid, value, transposed).groupBy("l", "i", "j").agg(F.sum("v").alias("v"))


def circular_terms(cube: DataFrame, psf: DataFrame, grid: GridSpec, value: str = "v", transposed: bool = False) -> DataFrame:
    """The terms of ``circular_blur``, which add up by (l, i, j)."""
    sign = -1 if transposed else 1
    spread = cube.join(psf, on=F.lit(True)) if "l" not in psf.columns else cube.join(psf, "l")
    at = lambda x, d, n: F.pmod(F.col(x) + sign * F.col(d), F.lit(n)).alias(x)
    return spread.select("l", at("i", "di", grid.rows), at("j", "dj", grid.columns), (F.col(value) * F.col("w")).alias("v"))


def only_reached(blurred: DataFrame, pixels: DataFrame, kernels: list[DataFrame], grid: GridSpec) -> DataFrame:
    """Blurred planes of the whole grid without the pixels that no value reaches.

    ``pixels`` are the distinct (i, j) there were before blurs by ``kernels``,
    one after the other. Nothing is joined where they reach the whole grid.
    """
    for psf in [None, *kernels]:
        if psf is not None:
            pixels = circular_terms(pixels.select(F.lit(0).alias("l"), "i", "j", F.lit(1).alias("v")), psf, grid).select("i", "j").distinct()
        if pixels.count() == grid.rows * grid.columns:
            return blurred
    return blurred.join(pixels, ["i", "j"], "left_semi")


def spectral_blur(slices: DataFrame, wpsf: DataFrame, value: str = "v", sum_columns: bool = False) -> DataFrame:
    """y(lp, i, j) = sum over l of x(l, i, j) w(lp, l, b = j), or summed over j."""
    weights = wpsf.withColumnRenamed("b", "j")
    return apply_weights(slices, weights, ["l", "j"], ["lp", "i"] if sum_columns else ["lp", "i", "j"], value)


def spectral_blur_adjoint(detector: DataFrame, wpsf: DataFrame, value: str = "v") -> DataFrame:
    return apply_weights(detector, wpsf.withColumnRenamed("b", "j"), ["lp", "j"], ["l", "i", "j"], value)


def spread_average(detector: DataFrame, wpsf: DataFrame, value: str = "v") -> DataFrame:
    """The weighted average of what falls on each voxel, 0 where nothing does."""
    joined = detector.withColumnRenamed(value, "_v").join(wpsf.withColumnRenamed("b", "j"), ["lp", "j"])
    mean = F.coalesce(F.try_divide(F.sum(F.col("_v") * F.col("w")).cast("double"), F.sum("w").cast("double")), F.lit(0.0))
    return joined.groupBy("l", "i", "j").agg(mean.alias("v"))


def box_decimate(cube: DataFrame, factor: int, samples: int, value: str = "v") -> DataFrame:
    """Box sum over ``factor`` rows, then every ``factor``-th: one tumbling sum."""
    return cube.where(F.col("i") < factor * samples).groupBy("l", F.expr(f"i div {factor}").cast("int").alias("a"), "j").agg(F.sum(value).alias("v"))


def box_decimate_adjoint(detector: DataFrame, factor: int, value: str = "v") -> DataFrame:
    return detector.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).select("l", (F.col("a") * factor + F.col("k")).cast("int").alias("i"), "j", F.col(value).alias("v"))


def bilinear_weights(targets: DataFrame, x0: float, hx: float, nx: int, y0: float, hy: float, ny: int, outside: str = "raise") -> DataFrame:
    """Four weights (i, j, w) for each target (t, x, y) on a regular grid.

    A target on the last knot belongs to the last interval. One outside the
    grid raises, or with ``outside='zero'`` gets no weights.
    """
    u, v = (F.col("x") - x0) / hx, (F.col("y") - y0) / hy
    inside = (u >= 0) & (u <= nx - 1) & (v >= 0) & (v <= ny - 1)
    placed = targets.withColumns({"u": u, "v": v, "inside": inside})
    if outside == "raise":
        placed = placed.where(F.when(~F.col("inside"), F.raise_error(F.lit("a target lies outside the grid"))).otherwise(F.lit(True)))
    else:
        placed = placed.where("inside")
    i0 = F.least(F.floor("u"), F.lit(nx - 2)).cast("int")
    j0 = F.least(F.floor("v"), F.lit(ny - 2)).cast("int")
    placed = placed.withColumns({"i0": i0, "j0": j0}).withColumns({"p": F.col("u") - F.col("i0"), "q": F.col("v") - F.col("j0")})
    corner = lambda a, b: F.struct((F.col("i0") + a).alias("i"), (F.col("j0") + b).alias("j"), ((F.col("p") if a else 1 - F.col("p")) * (F.col("q") if b else 1 - F.col("q"))).alias("w"))
    return placed.select("t", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("t", "c.i", "c.j", "c.w")


def nearest_weights(targets: DataFrame, x0: float, hx: float, nx: int, y0: float, hy: float, ny: int) -> DataFrame:
    """One weight for each target: the nearest knot, halves to the lower one."""
    near = lambda c, a, h, n: F.least(F.greatest(F.ceil((F.col(c) - a) / h - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    return targets.select("t", near("x", x0, hx, nx).alias("i"), near("y", y0, hy, ny).alias("j"), F.lit(1.0).alias("w"))


def interpolation(method: str, targets: DataFrame, *axes, outside: str = "raise") -> DataFrame:
    """Weights (t, i, j, w) on a regular grid by ``linear`` or ``nearest`` interpolation; another method is an error."""
    if method == "linear":
        return bilinear_weights(targets, *axes, outside=outside)
    if method == "nearest":
        return nearest_weights(targets, *axes)
    raise ValueError(f"no such interpolation: {method}")


def grid_forward(cube: DataFrame, weights: DataFrame, value: str = "v") -> DataFrame:
    return apply_weights(cube, weights, ["i", "j"], ["l", "t"], value)


def grid_adjoint(samples: DataFrame, weights: DataFrame, value: str = "v") -> DataFrame:
    return apply_weights(samples, weights, ["t"], ["l", "i", "j"], value)


def slice_forward(cube: DataFrame, slits: DataFrame, value: str = "v") -> DataFrame:
    """Weighted parts of a cube by slit: slits are (s, i, j, w)."""
    return cube.join(slits, ["i", "j"]).select("s", "l", "i", "j", (F.col(value) * F.col("w")).alias("v"))


def slice_adjoint(slices: DataFrame, slits: DataFrame, value: str = "v") -> DataFrame:
    return slices.withColumnRenamed(value, "_v").join(slits, ["s", "i", "j"]).groupBy("l", "i", "j").agg(F.sum(F.col("_v") * F.col("w")).alias("v"))


def slit_weights(spark: SparkSession, n_slits: int, width: float, rows: int) -> DataFrame:
    """Slits of fractional width over the columns: the share of each column in a slit."""
    s, j = spark.range(n_slits).select(F.col("id").cast("int").alias("s")), F.sequence(F.floor(F.col("s") * width).cast("int"), F.ceil((F.col("s") + 1) * width).cast("int") - 1)
    shares = s.withColumn("j", F.explode(j)).withColumn("w", F.least(F.col("j") + 1.0, (F.col("s") + 1) * width) - F.greatest(F.col("j") * 1.0, F.col("s") * width)).where("w > 1e-9")
    return shares.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select("s", "i", "j", "w")


def difference(cube: DataFrame, axis: str, n: int, value: str = "v", transposed: bool = False, pairs: bool = False) -> DataFrame:
    """Circular first difference x[k-1] - x[k] along an axis; transposed, y[k+1] - y[k].

    Each value goes to its own place and to its neighbour's with opposite
    signs, and a sum by place meets them: one shuffle, and no self-join.
    An absent value counts as 0, or with ``pairs`` has no difference.
    """
    shift = -1 if transposed else 1
    moved = F.pmod(F.col(axis) + shift, F.lit(n)).cast("int")
    both = F.array(F.struct(F.col(axis).alias("k"), (-F.col(value)).alias("v")), F.struct(moved.alias("k"), F.col(value).alias("v")))
    keys = [c for c in ("m", "l", "i", "j") if c in cube.columns and c != axis]
    spread = cube.select(*keys, F.explode(both).alias("e")).select(*keys, F.col("e.k").alias(axis), "e.v")
    if pairs:
        return spread.groupBy(*keys, axis).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")
    return spread.groupBy(*keys, axis).agg(F.sum("v").alias("v"))


def laplacian(cube: DataFrame, grid: GridSpec, value: str = "v") -> DataFrame:
    """The circular five-point Laplacian of each plane; it is its own adjoint."""
    return circular_blur(cube, laplacian_stencil(cube.sparkSession), grid, value)


def laplacian_stencil(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, 4), (0, 1, -1), (0, -1, -1), (1, 0, -1), (-1, 0, -1)], "di int, dj int, w int")


def dot(x: DataFrame, y: DataFrame, on: list[str], x_value: str = "v", y_value: str = "v") -> DataFrame:
    """The inner product of two vectors, as one row."""
    return x.withColumnRenamed(x_value, "_x").join(y.withColumnRenamed(y_value, "_y"), on).agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))


def transmittance(axis: DataFrame, points: DataFrame) -> DataFrame:
    """Linear interpolation of a filter curve (x, y) at an axis (l, x); 0 outside."""
    from pyspark.sql import Window

    nxt = Window.orderBy("x")
    pieces = points.select(F.col("x").alias("xa"), F.col("y").alias("ya"), F.lead("x").over(nxt).alias("xb"), F.lead("y").over(nxt).alias("yb")).withColumn("last", F.lead("xb").over(Window.orderBy("xa")).isNull())
    pieces = pieces.where("xb is not null")
    hit = (axis.x >= pieces.xa) & ((axis.x < pieces.xb) | (pieces.last & (axis.x == pieces.xb)))
    return axis.join(pieces, hit, "left").select("l", F.coalesce(F.col("ya") + (F.col("x") - F.col("xa")) / (F.col("xb") - F.col("xa")) * (F.col("yb") - F.col("ya")), F.lit(0.0)).alias("w"))


def integrate(cube: DataFrame, weights: DataFrame, value: str = "v") -> DataFrame:
    return apply_weights(cube, weights, ["l"], ["i", "j"], value)


def window_offset(axis: list[float], at: float, width: int) -> tuple[int, int]:
    """First index and end of a window of about ``width`` around the nearest sample, the first of several."""
    middle = min(range(len(axis)), key=lambda k: (abs(axis[k] - at), k))
    return middle - width // 2, middle + width // 2 + 1


def crop_window(plane: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The part of (…, i, j, v) in a window, counted from its corner."""
    inside = (F.col("i") >= rows[0]) & (F.col("i") < rows[1]) & (F.col("j") >= columns[0]) & (F.col("j") < columns[1])
    return plane.where(inside).withColumns({"i": (F.col("i") - rows[0]).cast("int"), "j": (F.col("j") - columns[0]).cast("int")})


def paste_window(local: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """A window's part back at its place; pixels outside are absent, that is 0."""
    return local.withColumns({"i": (F.col("i") + rows[0]).cast("int"), "j": (F.col("j") + columns[0]).cast("int")})


def mixing_normal(maps: DataFrame, templates: DataFrame, kept: DataFrame) -> DataFrame:
    """Adjoint after forward mixing, over the kept voxels (l, i, j) only: (m, i, j, a)."""
    cube = mix_maps(maps, templates).join(kept.select("l", "i", "j"), ["l", "i", "j"], "left_semi")
    return unmix_cube(cube, templates)

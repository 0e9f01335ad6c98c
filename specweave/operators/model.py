"""Linear operators as values, and the spectrograph's chain built of them.

A ``LinearOperator`` holds a forward map between relations and its adjoint;
``@`` chains two of them. The composite model is one plan over all channels
and pointings: these are keys of the weights, not loops.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import schema
from specweave.operators import dense, linear
from specweave.schema import GridSpec


@dataclass(frozen=True)
class LinearOperator:
    """A linear map and its adjoint. Anything that has both can take part in a chain, a solver or a dot test."""

    forward: Callable[[DataFrame], DataFrame]
    adjoint: Callable[[DataFrame], DataFrame]

    def __matmul__(self, inner: LinearOperator) -> LinearOperator:
        return LinearOperator(lambda x: self.forward(inner.forward(x)), lambda y: inner.adjoint(self.adjoint(y)))

    @property
    def transposed(self) -> LinearOperator:
        return LinearOperator(self.adjoint, self.forward)

    def normal(self, x: DataFrame) -> DataFrame:
        return self.adjoint(self.forward(x))

    def dot_test(self, x: DataFrame, y: DataFrame, x_keys: list[str], y_keys: list[str]) -> DataFrame:
        """<y, H x> and <Ht y, x> as one row (y_hx, hty_x); vectors have their value in ``v``."""
        product = lambda a, b, on, name: a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), on).agg(F.coalesce(F.sum((F.col("_a") * F.col("_b")).cast("decimal(38,6)")), F.lit(0)).cast("double").alias(name))
        return product(y, self.forward(x), y_keys, "y_hx").join(product(self.adjoint(y), x, x_keys, "hty_x"), F.lit(True))


def weighted(weights: DataFrame, inputs: list[str], outputs: list[str], along: list[str]) -> LinearOperator:
    """The operator of a weight relation from ``inputs`` to ``outputs``; ``along`` are keys of the vectors that it leaves alone."""
    shared = [k for k in inputs if k in outputs]
    own_in, own_out = [k for k in inputs if k not in shared], [k for k in outputs if k not in shared]
    keys = [k for k in along if k not in shared]
    return LinearOperator(lambda x: linear.apply_weights(x, weights, shared + own_in, [*keys, *shared, *own_out]), lambda y: linear.apply_weights(y, weights, shared + own_out, [*keys, *shared, *own_in]))


def mixing(templates: DataFrame) -> LinearOperator:
    """T: maps (m, i, j, v) to a cube (l, i, j, v)."""
    return LinearOperator(lambda x: linear.mix_maps(x.withColumnRenamed("v", "a"), templates), lambda y: linear.unmix_cube(y, templates).withColumnRenamed("a", "v"))


def blur(psf: DataFrame, grid: GridSpec, taps: int = 64) -> LinearOperator:
    """C: circular blur of each plane.

    A kernel of few taps is a join, each value going to the places that it
    reaches; one of more than ``taps`` goes through the Fourier domain, where
    its size doesn't matter. The kernel is geometry, no larger than a plane.
    """
    if "l" not in psf.columns and psf.count() > taps:
        kernel = np.zeros((grid.rows, grid.columns))
        for di, dj, w in psf.select("di", "dj", "w").collect():
            kernel[di % grid.rows, dj % grid.columns] += w
        otf = np.fft.rfft2(kernel)
        dense_ = lambda x, turned: schema.from_planes(dense.fft_blur(schema.planes(x), otf, grid, turned), grid).select("l", "i", "j", "v")
        return LinearOperator(lambda x: dense_(x, False), lambda y: dense_(y, True))
    return LinearOperator(lambda x: linear.circular_blur(x, psf, grid), lambda y: linear.circular_blur(y, psf, grid, transposed=True))


def gridding(fields: DataFrame) -> LinearOperator:
    """S: a cube to each observation's field, (chan, p, l, a, b), in the wavelengths of its channel.

    ``fields`` is (chan, p, a, b, i, j, w, first, stop).
    """
    seen = lambda rows: rows.where((F.col("l") >= F.col("first")) & (F.col("l") < F.col("stop")))

    def forward(x: DataFrame) -> DataFrame:
        return seen(x.withColumnRenamed("v", "_v").join(fields, ["i", "j"])).groupBy("chan", "p", "l", "a", "b").agg(F.sum(F.col("_v") * F.col("w")).alias("v"))

    def adjoint(y: DataFrame) -> DataFrame:
        return seen(y.withColumnRenamed("v", "_v").join(fields, ["chan", "p", "a", "b"])).groupBy("l", "i", "j").agg(F.sum(F.col("_v") * F.col("w")).alias("v"))

    return LinearOperator(forward, adjoint)


def slicing(slits: DataFrame, factor: int, samples: int) -> LinearOperator:
    """L and the box sum: fields to slits, ``samples`` sums of ``factor`` rows each.

    ``slits`` is (chan, s, a, b, w); the result (chan, p, s, l, i, b).
    """
    inside = slits.where(F.col("a") < factor * samples).withColumn("i", F.expr(f"a div {factor}").cast("int"))
    return weighted(inside, ["chan", "a", "b"], ["chan", "s", "i", "b"], ["p", "l"])


def response(wpsf: DataFrame) -> LinearOperator:
    """R summed over the columns: (chan, p, s, l, i, b) to detector samples (chan, p, s, lp, i), by (lp, l, b, w)."""
    return weighted(wpsf, ["l", "b"], ["lp"], ["chan", "p", "s", "i"])


def spectrograph(templates: DataFrame, psf: DataFrame, grid: GridSpec, fields: DataFrame, slits: DataFrame, wpsf: DataFrame, factor: int, samples: int) -> LinearOperator:
    """R L S C T over all channels and pointings: maps (m, i, j, v) to samples (chan, p, s, lp, i, v)."""
    return response(wpsf) @ slicing(slits, factor, samples) @ gridding(fields) @ blur(psf, grid) @ mixing(templates)


def plane_spectrograph(psf: DataFrame, grid: GridSpec, fields: DataFrame, slits: DataFrame, factor: int, samples: int) -> LinearOperator:
    """The same for one wavelength: a plane (l, i, j, v) to samples (chan, p, s, i, v), blurred, cut and summed over the columns."""
    sums = LinearOperator(lambda x: x.groupBy("chan", "p", "s", "l", "i").agg(F.sum("v").alias("v")), lambda y: y.join(slits.select("chan", "s", "b").distinct(), ["chan", "s"]))
    return sums @ slicing(slits, factor, samples) @ gridding(fields) @ blur(psf, grid)


def throughput(share: DataFrame) -> LinearOperator:
    """W: each plane times its share (l, w)."""
    scaled = lambda x: x.join(share, "l").select(*x.columns[:-1], (F.col("v") * F.col("w")).alias("v"))
    return LinearOperator(lambda x: scaled(x.select("l", "i", "j", "v")), lambda y: scaled(y.select("l", "i", "j", "v")))


def regridded(samples: DataFrame, pixels: DataFrame, x0: float, hx: float, nx: int, y0: float, hy: float, ny: int) -> DataFrame:
    """S': fields (…, a, b, v) read again by bilinear interpolation at pixels (t, x, y) in local coordinates; 0 outside.

    It isn't the adjoint of gridding. Every pixel has a value in each plane
    that the fields have.
    """
    w = linear.bilinear_weights(pixels, x0, hx, nx, y0, hy, ny, "zero").withColumnsRenamed({"i": "a", "j": "b"})
    keys = [c for c in samples.columns if c not in ("a", "b", "v")]
    found = linear.apply_weights(samples, w, ["a", "b"], [*keys, "t"])
    everywhere = samples.select(*keys).distinct().join(pixels.select("t"), F.lit(True))
    return everywhere.join(found, [*keys, "t"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def back_projected(detector: DataFrame, slits: DataFrame, factor: int) -> DataFrame:
    """Samples (…, s, i, v) spread evenly over their slit's columns and rows: local images (…, a, b, v).

    A sample counts as its share of ``factor`` rows and of the slit's
    columns, times the slit's weight there.
    """
    keys = [c for c in detector.columns if c not in ("s", "i", "v")]
    wide = slits.where("a = 0").groupBy("s").agg(F.count("*").alias("n"))
    spread = detector.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("a", (F.col("i") * factor + F.col("k")).cast("int"))
    joined = spread.join(wide, "s").join(slits, ["s", "a"])
    return joined.groupBy(*keys, "a", "b").agg(F.sum(F.col("v") * F.col("w") / (F.col("n") * factor)).alias("v"))


def covered(targets: DataFrame, x0: float, hx: float, nx: int, y0: float, hy: float, ny: int) -> DataFrame:
    """The pixels (i, j) nearest to some target (t, x, y) on a regular grid."""
    return linear.nearest_weights(targets, x0, hx, nx, y0, hy, ny).select("i", "j").distinct()


def diffracted(psf: DataFrame, template: DataFrame, wpsf: DataFrame) -> DataFrame:
    """Spatial responses (l, a, b, w) weighted by a template (l, t), through the spectral response (lp, l, b, w): (lp, a, b, v)."""
    seen = psf.join(template, "l").select("l", "a", "b", (F.col("w") * F.col("t")).alias("v"))
    return linear.apply_weights(seen, wpsf, ["l", "b"], ["lp", "a", "b"])

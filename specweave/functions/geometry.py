"""Coordinates, fields of view and slits, as column expressions and tables.

Angles are degrees. ``rotated`` turns a coordinate by minus the angle and
``to_global`` by plus it, as instruments describe themselves; the two are
kept apart on purpose.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed instrument values by band: slits, resolution bounds, pixel, field of view (arcsec), samples along wavelength and alpha.
BANDS = {
    "1a": (21, 3320, 3710, 0.196, 3.2, 3.7, 1050, 19),
    "1b": (21, 3190, 3750, 0.196, 3.2, 3.7, 1213, 19),
    "1c": (21, 3100, 3610, 0.196, 3.2, 3.7, 1400, 19),
    "2a": (17, 2990, 3110, 0.196, 4.0, 4.8, 970, 24),
    "2b": (17, 2750, 3170, 0.196, 4.0, 4.8, 1124, 24),
    "2c": (17, 2860, 3300, 0.196, 4.0, 4.8, 1300, 24),
    "3a": (16, 2530, 2880, 0.245, 5.2, 6.2, 769, 24),
    "3b": (16, 1790, 2640, 0.245, 5.2, 6.2, 892, 24),
    "3c": (16, 1980, 2790, 0.245, 5.2, 6.2, 1028, 24),
    "4a": (12, 1460, 1930, 0.273, 6.6, 7.7, 542, 27),
    "4b": (12, 1680, 1760, 0.273, 6.6, 7.7, 632, 27),
    "4c": (12, 1630, 1330, 0.273, 6.6, 7.7, 717, 27),
}


def instruments(spark: SparkSession) -> DataFrame:
    rows = [(b, n, (lo + hi) / 2, px, fa, fb, nl, na) for b, (n, lo, hi, px, fa, fb, nl, na) in BANDS.items()]
    return spark.createDataFrame(rows, "chan string, n_slit int, resolution double, det_pix double, alpha_width double, beta_width double, n_lambda int, n_alpha int")


def rotation(degrees: Column | float) -> tuple[Column, Column]:
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    return F.cos(a), F.sin(a)


def rotated(alpha: Column, beta: Column, degrees) -> tuple[Column, Column]:
    """A coordinate turned by minus the angle."""
    c, s = rotation(degrees)
    return c * alpha + s * beta, c * beta - s * alpha


def to_global(alpha: Column, beta: Column, degrees, origin: tuple[Column, Column]) -> tuple[Column, Column]:
    c, s = rotation(degrees)
    return c * alpha - s * beta + origin[0], s * alpha + c * beta + origin[1]


def to_local(alpha: Column, beta: Column, degrees, origin: tuple[Column, Column]) -> tuple[Column, Column]:
    return rotated(alpha - origin[0], beta - origin[1], degrees)


def snapped(x: Column, step: float) -> Column:
    """The nearest multiple of a step, halves to the even one."""
    return F.bround(x / step) * step


def corners(alpha_width: Column, beta_width: Column, degrees, origin: tuple[Column, Column]) -> Column:
    """The four corners of a turned rectangle, as an array of structs."""
    out = []
    for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        x, y = rotated(a * alpha_width / 2, b * beta_width / 2, degrees)
        out.append(F.struct((x + origin[0]).alias("alpha"), (y + origin[1]).alias("beta")))
    return F.array(*out)


def common_step(sizes: list[float], tolerance: float = 3) -> float:
    """The smallest size over the least whole number that divides all sizes nearly."""
    least, n = min(sizes), 1
    while any(s % (least / n) > least / tolerance for s in sizes):
        n += 1
    return least / n


def super_resolution(size: float, step: float) -> int:
    return int(size // step)


def local_axis(width: float, step: float, margin: float = 0.0, start: float | None = None) -> list[float]:
    """Grid points that cover a centred width and its margin, on multiples of a step."""
    begin = (-width / 2 if start is None else start) - margin
    length = width + 2 * margin
    first = math.floor(begin / step) * step
    n = math.ceil((length + begin - first) / step) + 1
    return [first + k * step for k in range(n)]


def pixels_across(width: float, axis: list[float]) -> int:
    """Samples of an axis across a centred width.

    The step is the difference of the first two samples as floating point has
    it, so that a width that is a whole number of steps may take one more at
    either end: in degrees, 4.0 arc seconds on steps of 0.025 are 162.
    """
    step = axis[1] - axis[0]
    return math.ceil(width / 2 / step) - math.floor(-width / 2 / step)


def columns_across(width: float, axis: list[float]) -> int:
    return math.ceil(width / (axis[1] - axis[0]))


def detector_shapes(spark: SparkSession, step: float = 0.025, margin: int = 5) -> DataFrame:
    """(chan, factor, pixels, samples, columns) of each band's slits: one row a band.

    The super-resolution factor, the local grid's rows and columns across a
    slit, and the detector's samples along it. ``step`` is in arc seconds;
    axes are in degrees, which decides how their steps round.
    """
    rows = []
    step = step / 3600
    for band, (slits_, _, _, *widths, _, _) in BANDS.items():
        pixel, alpha, beta = (w / 3600 for w in widths)
        a, b = (local_axis(w, step, margin * step) for w in (alpha, beta))
        factor, across = super_resolution(pixel, step), pixels_across(alpha, a)
        rows.append((band, factor, across, math.ceil(across / factor), columns_across(beta / slits_, b)))
    return spark.createDataFrame(rows, "chan string, factor int, pixels int, samples int, columns int")


def view_of_all(pointings: DataFrame, fields: DataFrame, margin: float = 5.0) -> DataFrame:
    """The box (alpha0, beta0, alpha1, beta1) around all fields at all pointings, as one row.

    ``fields`` has each instrument's box (a0, a1, b0, b1) about its origin.
    Fixed rules: the lower ends subtract the smallest pointing, and the upper
    end along beta takes the smallest of the fields' ends.
    """
    p = pointings.agg(*[f(c).alias(f"{c}{n}") for c in ("alpha", "beta") for f, n in ((F.min, 0), (F.max, 1))])
    f = fields.agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.min("b1").alias("b1"))
    col = F.col
    return f.join(p, F.lit(True)).select((col("a0") - col("alpha0") - margin).alias("alpha0"), (col("b0") - col("beta0") - margin).alias("beta0"), (col("a1") + col("alpha1") + margin).alias("alpha1"), (col("b1") + col("beta1") + margin).alias("beta1"))


def field_box(alpha_width: Column, beta_width: Column, degrees, origin: tuple[Column, Column]) -> dict[str, Column]:
    """The extents a0, a1, b0, b1 of a turned field."""
    box = corners(alpha_width, beta_width, degrees, origin)
    return {f"{n[0]}{k}": f(box[n]) for n in ("alpha", "beta") for f, k in ((F.array_min, 0), (F.array_max, 1))}


def wavelength_properties(axis: Column) -> dict[str, Column]:
    """First, last, step and number of an axis, an array."""
    return {"wavel_min": axis[0], "wavel_max": F.element_at(axis, -1), "wavel_step": F.get(axis, F.lit(1)) - axis[0], "n_wavel": F.size(axis)}


def axis_from_header(n: Column, reference: Column, step: Column, value: Column) -> Column:
    """(k + reference - 1) * step + value, for k from 0 to n - 1."""
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: (k + reference - 1) * step + value)


def index_window(axis: DataFrame, low: float, high: float, half: float = 0.0) -> DataFrame:
    """First index whose sample reaches past ``low``, and one past the last before ``high``."""
    return axis.agg(F.min(F.when(F.col("x") + half > low, F.col("idx"))).alias("first"), (F.max(F.when(F.col("x") - half < high, F.col("idx"))) + 1).alias("stop"))


def wavelength_window(axis: DataFrame, low: float, high: float, margin: float = 0.0) -> DataFrame:
    """[last sample at or below the low end, first at or above the high end)."""
    ends = axis.agg(F.min("x").alias("x0"), F.max("x").alias("xn"))
    held = axis.join(F.broadcast(ends), F.lit(True))
    lo, hi = F.greatest(F.lit(low - margin), F.col("x0")), F.least(F.lit(high + margin), F.col("xn"))
    return held.agg(F.max(F.when(F.col("x") <= lo, F.col("idx"))).alias("first"), F.min(F.when(F.col("x") >= hi, F.col("idx"))).alias("stop"))


def slits(instruments_: DataFrame) -> DataFrame:
    """One row a slit: its width and its shift from the centre of the field."""
    width = F.col("beta_width") / F.col("n_slit")
    return instruments_.withColumn("slit", F.explode(F.sequence(F.lit(0), F.col("n_slit") - 1))).select("chan", "slit", width.alias("width"), ((F.col("slit") + 0.5) * width - F.col("beta_width") / 2).alias("shift"))


def oversampled(coords: DataFrame, k: int, step: float) -> DataFrame:
    """k by k sub-pixel coordinates of each pixel that isn't on the border."""
    edge = coords.agg(F.max("i").alias("_ni"), F.max("j").alias("_nj"))
    inner = coords.join(F.broadcast(edge), (F.col("i") > 0) & (F.col("j") > 0) & (F.col("i") < F.col("_ni")) & (F.col("j") < F.col("_nj")))
    near = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    spread = inner.withColumn("a", near).withColumn("b", near)
    return spread.select((F.col("i") * k + F.col("a")).cast("int").alias("i"), (F.col("j") * k + F.col("b")).cast("int").alias("j"), (F.col("alpha") + F.col("a") * step).alias("alpha"), (F.col("beta") + F.col("b") * step).alias("beta"))


def linear_sky(i: Column, j: Column, header: dict[str, float]) -> tuple[Column, Column]:
    """Pixel to sky by the header's linear terms."""
    x, y = j + 1 - header["CRPIX1"], i + 1 - header["CRPIX2"]
    u = (x * header.get("PC1_1", 1.0) + y * header.get("PC1_2", 0.0)) * header["CDELT1"]
    v = (x * header.get("PC2_1", 0.0) + y * header.get("PC2_2", 1.0)) * header["CDELT2"]
    return u + header["CRVAL1"], v + header["CRVAL2"]


def gnomonic_sky(i: Column, j: Column, header: dict[str, float]) -> tuple[Column, Column]:
    """Pixel to right ascension and declination through the tangent plane."""
    u, v = (F.radians(c - F.lit(header[k])) for c, k in zip(linear_sky(i, j, header), ("CRVAL1", "CRVAL2"), strict=True))
    d0 = F.radians(F.lit(header["CRVAL2"]))
    base = F.cos(d0) - v * F.sin(d0)
    alpha = F.degrees(F.atan2(u, base)) + header["CRVAL1"]
    return alpha, F.degrees(F.atan2(F.sin(d0) + v * F.cos(d0), F.sqrt(u * u + base * base)))


def fractional_slits(spark: SparkSession, alpha_axis: list[float], beta_axis: list[float], alpha_width: float, beta_width: float, n_slits: int, factor: int | None = None) -> DataFrame:
    """Weights (s, i, j, w) of the slits of a field on its local grid.

    A slit takes the samples whose cells it touches, at most as many columns
    as its width spans; of too many, the column farther beyond its own edge
    goes. With the super-resolution ``factor``, a slit of an even number of
    detector samples below 28 is mended by a fixed rule: of more rows than
    ``pixels_across`` the last goes, to fewer two are added at the beginning. An edge column weighs the share of its cell in the slit where the
    neighbouring slit has it too, and 1 where it does not. The tables are as
    long as the slits, built here and shipped.
    """
    ha, hb = alpha_axis[1] - alpha_axis[0], beta_axis[1] - beta_axis[0]
    touched = lambda axis, h, lo, hi: (min(k for k, x in enumerate(axis) if lo < x + h / 2), max(k for k, x in enumerate(axis) if x - h / 2 < hi) + 1)
    width = beta_width / n_slits
    rows = touched(alpha_axis, ha, -alpha_width / 2, alpha_width / 2)
    if factor:
        across = pixels_across(alpha_width, alpha_axis)
        samples = math.ceil(across / factor)
        if samples % 2 == 0 and samples < 28 and rows[1] - rows[0] != across:
            rows = (rows[0], rows[1] - 1) if rows[1] - rows[0] > across else (max(0, rows[0] - 2), rows[1])
    edges = [(s * width - beta_width / 2, (s + 1) * width - beta_width / 2) for s in range(n_slits)]
    spans = []
    for lo, hi in edges:
        first, stop = touched(beta_axis, hb, lo, hi)
        if stop - first > columns_across(width, beta_axis):
            beyond = abs(beta_axis[min(stop, len(beta_axis) - 1)] - hi) > abs(beta_axis[first] - lo)
            first, stop = (first, stop - 1) if beyond else (first + 1, stop)
        spans.append((first, stop))
    out = []
    for s, ((first, stop), (lo, hi)) in enumerate(zip(spans, edges, strict=True)):
        w = dict.fromkeys(range(first, stop), 1.0)
        if beta_axis[first] - hb / 2 < lo and (s == 0 or spans[s - 1][1] - 1 == first):
            w[first] = 1 - (lo - beta_axis[first] + hb / 2) / hb
        if beta_axis[stop - 1] + hb / 2 > hi and (s == n_slits - 1 or spans[s + 1][0] == stop - 1):
            w[stop - 1] = 1 - (beta_axis[stop - 1] + hb / 2 - hi) / hb
        out += [(s, j, x) for j, x in w.items()]
    table = spark.createDataFrame(out, "s int, j int, w double")
    return table.select("s", F.explode(F.sequence(F.lit(rows[0]), F.lit(rows[1] - 1))).alias("i"), "j", "w")

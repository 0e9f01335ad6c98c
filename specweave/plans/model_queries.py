"""Queries of the composite model and of the instrument's remaining parts, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from specweave import schema
from specweave.functions import geometry as geo
from specweave.operators import dense, linear, metrics, model, neighbours, ordered, selection
from specweave.plans import fixtures as fx
from specweave.plans import fusion
from specweave.plans.cube_queries import INSIDE
from specweave.plans.instrument_queries import _FILES, _files
from specweave.plans.registry import register
from specweave.runtime import materialize
from specweave.sources import files, headers, simulation

#: Two channels of two pointings each: (channel, pointing, offsets along alpha and beta, first wavelength and one past the last).
OBSERVATIONS = [("a", 0, 0.25, 0.5, 0, 40), ("a", 1, 0.75, 0.25, 0, 40), ("b", 0, 0.5, 0.25, 24, 64), ("b", 1, 0.0, 0.75, 24, 64)]
FACTOR, SLITS, WIDTH = 3, 7, 3.5


def _grid(spark, d):
    return schema.GridSpec(fx.rows_of(spark, d), fx.COLUMNS, fx.PLANES)


# The composite model, in whole numbers and dyadic weights --------------------------

_OBS = "obs AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {p}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {lo}, {hi})" for c, p, a, b, lo, hi in OBSERVATIONS) + ") AS t(chan, p, da, db, first, stop))"
_MODEL = ", " + _OBS + """, fields AS (SELECT chan, p, first, stop, a, b, a + u AS i, b + v AS j, (CASE u WHEN 1 THEN da ELSE 1 - da END) * (CASE v WHEN 1 THEN db ELSE 1 - db END) AS w
    FROM obs, size, (SELECT DISTINCT i AS a, j AS b FROM cube), range(0, 2) AS p1(u), range(0, 2) AS p2(v) WHERE a < n - 1 AND b < 24
), cut AS (SELECT chan, s, a, j AS b, w FROM slits, size, (SELECT DISTINCT chan FROM obs), (SELECT DISTINCT i AS a FROM cube) WHERE j < 24 AND a < 3 * ((n - 1) // 3)
), x AS (SELECT m, i, j, CAST(a AS BIGINT) // 1000 AS v FROM maps)"""
_BLUR = """SELECT l, (i + di + n) % n AS i, (j + dj + 25) % 25 AS j, sum(v * psf.w) AS v FROM {of}, psf, size GROUP BY ALL"""
_TO_SLITS = """, field AS (SELECT chan, p, l, a, b, sum(v * w) AS v FROM blurred JOIN fields USING (i, j) WHERE l >= first AND l < stop GROUP BY ALL
), boxed AS (SELECT chan, p, s, l, a // 3 AS i, b, sum(v * w) AS v FROM field JOIN cut USING (chan, a, b) GROUP BY ALL)"""
_FORWARD = """, mixed AS (SELECT l, i, j, sum(v * t) AS v FROM x JOIN templates USING (m) GROUP BY l, i, j
), blurred AS (""" + _BLUR.format(of="mixed") + ")" + _TO_SLITS + """, fwd AS (SELECT chan, p, s, lp, i, CAST(sum(v * w) AS DOUBLE) AS v FROM boxed JOIN wpsf USING (l, b) GROUP BY ALL)"""
_SAMPLES = """, y AS (SELECT chan, p, j AS s, l AS lp, i, q + p + 1 AS v FROM cube, obs, size WHERE l < 32 AND j < 7 AND i < (n - 1) // 3)"""
_FROM_SLITS = """, unsliced AS (SELECT chan, p, l, a, b, sum(v * w) AS v FROM {of} JOIN cut USING (chan, s, b) WHERE a // 3 = i GROUP BY ALL
), ungridded AS (SELECT l, f.i AS i, f.j AS j, sum(v * w) AS v FROM unsliced u JOIN fields f USING (chan, p, a, b) WHERE l >= first AND l < stop GROUP BY ALL
), unblurred AS (SELECT l, (i - di + n) % n AS i, (j - dj + 25) % 25 AS j, sum(v * psf.w) AS v FROM ungridded, psf, size GROUP BY ALL)"""
_ADJOINT = """, spread AS (SELECT chan, p, s, wpsf.l AS l, i, wpsf.b AS b, sum(v * w) AS v FROM y JOIN wpsf USING (lp) GROUP BY ALL)""" + _FROM_SLITS.format(of="spread") + """
, adj AS (SELECT m, i, j, CAST(sum(v * t) AS DOUBLE) AS v FROM unblurred JOIN templates USING (l) GROUP BY m, i, j)"""
_ALL = fx.sql("cube", "templates", "maps", "psf", "wpsf", "slits", "size") + _MODEL


def _relations(spark, d):
    """(fields, slits, samples along a slit) of all observations."""
    rows = fx.rows_of(spark, d)
    obs = spark.createDataFrame(OBSERVATIONS, "chan string, p int, da double, db double, first int, stop int")
    points = spark.range(rows - 1).select(F.col("id").cast("int").alias("a")).join(spark.range(fx.COLUMNS - 1).select(F.col("id").cast("int").alias("b")), F.lit(True))
    at = points.join(F.broadcast(obs), F.lit(True)).select(F.struct("chan", "p", "a", "b", "first", "stop").alias("t"), (F.col("a") + F.col("da")).alias("x"), (F.col("b") + F.col("db")).alias("y"))
    fields = linear.bilinear_weights(at, 0.0, 1.0, rows, 0.0, 1.0, fx.COLUMNS).where("w > 0").select("t.*", "i", "j", "w")
    slits = linear.slit_weights(spark, SLITS, WIDTH, rows - 1).where(f"j < {fx.COLUMNS - 1}").select("s", F.col("i").alias("a"), F.col("j").alias("b"), "w")
    return materialize(fields, "fields"), materialize(slits.join(F.broadcast(obs.select("chan").distinct()), F.lit(True)).select("chan", "s", "a", "b", "w"), "slits"), (rows - 1) // FACTOR


def _model(spark, d):
    """The operator, and maps to apply it to."""
    c, g = fx.cube(spark, d), _grid(spark, d)
    templates = materialize(fx.templates(c), "templates")
    x = materialize(linear.unmix_cube(c, templates, "q").select("m", "i", "j", F.expr("a div 1000").cast("double").alias("v")), "maps")
    fields, slits, samples = _relations(spark, d)
    return model.spectrograph(templates, fx.psf(spark), g, fields, slits, fx.wpsf(spark), FACTOR, samples), x


def _samples(spark, d):
    """Detector samples that don't come from the model."""
    n = (fx.rows_of(spark, d) - 1) // FACTOR
    obs = spark.createDataFrame([o[:2] for o in OBSERVATIONS], "chan string, p int")
    y = fx.cube(spark, d).where(f"l < 32 and j < {SLITS} and i < {n}").join(F.broadcast(obs), F.lit(True))
    return y.select("chan", "p", F.col("j").alias("s"), F.col("l").alias("lp"), "i", (F.col("q") + F.col("p") + 1).cast("double").alias("v"))


@register("forward_mcmo", _ALL + _FORWARD + "SELECT chan, CAST(p AS INTEGER) AS p, s, lp, CAST(i AS INTEGER) AS i, v + 0.0 AS v FROM fwd")
def forward_mcmo(spark, d):
    """Mixing, blur, gridding, slicing, box sum and response over two channels of two pointings."""
    operator, x = _model(spark, d)
    return operator.forward(x).select("chan", "p", "s", "lp", "i", (F.col("v") + 0.0).alias("v"))


@register("adjoint_mcmo", _ALL + _SAMPLES + _ADJOINT + "SELECT m, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, v + 0.0 AS v FROM adj")
def adjoint_mcmo(spark, d):
    return _model(spark, d)[0].adjoint(_samples(spark, d)).select("m", "i", "j", (F.col("v") + 0.0).alias("v"))


@register("dot_mcmo", _ALL + _FORWARD + _SAMPLES + _ADJOINT + """SELECT CAST((SELECT sum(CAST(y.v * fwd.v AS DECIMAL(38, 6))) FROM y JOIN fwd USING (chan, p, s, lp, i)) AS DOUBLE) AS y_hx,
CAST((SELECT sum(CAST(adj.v * x.v AS DECIMAL(38, 6))) FROM adj JOIN x USING (m, i, j)) AS DOUBLE) AS hty_x""")
def dot_mcmo(spark, d):
    operator, x = _model(spark, d)
    return operator.dot_test(x, _samples(spark, d), ["m", "i", "j"], ["chan", "p", "s", "lp", "i"])


# One wavelength --------------------------------------------------------------------

_PLANES = fx.sql("cube", "templates", "maps", "psf", "wpsf", "slits", "size") + _MODEL
_PLANE_Y = ", y AS (SELECT chan, p, j AS s, l, i, q + p + 1 AS v FROM cube, obs, size WHERE j < 7 AND i < (n - 1) // 3)"


def _plane_model(spark, d):
    fields, slits, samples = _relations(spark, d)
    return model.plane_spectrograph(fx.psf(spark), _grid(spark, d), fields, slits, FACTOR, samples)


@register("plane_forward", _PLANES + ", planes AS (SELECT l, i, j, q AS v FROM cube), blurred AS (" + _BLUR.format(of="planes") + ")" + _TO_SLITS + "SELECT chan, CAST(p AS INTEGER) AS p, s, l, CAST(i AS INTEGER) AS i, CAST(sum(v) AS DOUBLE) + 0.0 AS v FROM boxed GROUP BY chan, p, s, l, i")
def plane_forward(spark, d):
    """The model without mixing and response, each wavelength for itself."""
    return _plane_model(spark, d).forward(fx.cube(spark, d).select("l", "i", "j", F.col("q").cast("double").alias("v"))).select("chan", "p", "s", "l", "i", (F.col("v") + 0.0).alias("v"))


@register("plane_adjoint", _PLANES + _PLANE_Y + ", spread AS (SELECT y.*, b FROM y JOIN (SELECT DISTINCT chan, s, b FROM cut) USING (chan, s))" + _FROM_SLITS.format(of="spread") + "SELECT l, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(v AS DOUBLE) + 0.0 AS v FROM unblurred")
def plane_adjoint(spark, d):
    n = (fx.rows_of(spark, d) - 1) // FACTOR
    obs = spark.createDataFrame([o[:2] for o in OBSERVATIONS], "chan string, p int")
    y = fx.cube(spark, d).where(f"j < {SLITS} and i < {n}").join(F.broadcast(obs), F.lit(True)).select("chan", "p", F.col("j").alias("s"), "l", "i", (F.col("q") + F.col("p") + 1).cast("double").alias("v"))
    return _plane_model(spark, d).adjoint(y).select("l", "i", "j", (F.col("v") + 0.0).alias("v"))


# Back-projection and masks -----------------------------------------------------------

_IMAGES = fx.sql("cube", "slits", "size") + ", " + _OBS + """, y AS (SELECT chan, p, l, j AS s, i, q + p + 1 AS v FROM cube, obs, size WHERE j < 7 AND i < (n - 1) // 3 AND l >= first AND l < stop
), wide AS (SELECT s, count(*) AS k FROM slits WHERE j < 24 GROUP BY s
), image AS (SELECT chan, p, l, i * 3 + u AS a, j AS b, sum(v * w / (k * 3)) AS v FROM y JOIN wide USING (s) JOIN slits USING (s), range(0, 3) AS r(u) WHERE slits.j < 24 GROUP BY ALL
), near AS (SELECT chan, p, c.i, c.j, floor(c.i - da) AS a0, floor(c.j - db) AS b0, c.i - da - floor(c.i - da) AS u, c.j - db - floor(c.j - db) AS v FROM obs, size, (SELECT DISTINCT i, j FROM cube) c
    WHERE c.i - da >= 0 AND c.j - db >= 0 AND c.i - da <= n - 2 AND c.j - db <= 23
), back AS (SELECT image.chan AS chan, l, near.i AS i, near.j AS j, sum(image.v * (CASE WHEN image.a = a0 THEN 1 - u ELSE u END) * (CASE WHEN image.b = b0 THEN 1 - near.v ELSE near.v END)) AS v
    FROM near JOIN image ON image.chan = near.chan AND image.p = near.p AND image.a BETWEEN a0 AND a0 + 1 AND image.b BETWEEN b0 AND b0 + 1 GROUP BY ALL)"""


def _back(spark, d):
    """(chan, l, i, j, v): all pointings of each channel back on the sky, read by interpolation."""
    rows = fx.rows_of(spark, d)
    n = (rows - 1) // FACTOR
    obs = spark.createDataFrame(OBSERVATIONS, "chan string, p int, da double, db double, first int, stop int")
    y = fx.cube(spark, d).where(f"j < {SLITS} and i < {n}").join(F.broadcast(obs), F.lit(True)).where("l >= first and l < stop").select("chan", "p", "l", F.col("j").alias("s"), "i", (F.col("q") + F.col("p") + 1).cast("double").alias("v"))
    slits = linear.slit_weights(spark, SLITS, WIDTH, rows - 1).where(f"j < {fx.COLUMNS - 1}").select("s", F.col("i").alias("a"), F.col("j").alias("b"), "w")
    images = model.back_projected(y, slits, FACTOR)
    pixels = fx.cube(spark, d).where("l = 0").join(F.broadcast(obs), F.lit(True)).select(F.struct("chan", "p", "i", "j").alias("t"), (F.col("i") - F.col("da")).alias("x"), (F.col("j") - F.col("db")).alias("y"))
    w = linear.bilinear_weights(pixels, 0.0, 1.0, rows - 1, 0.0, 1.0, fx.COLUMNS - 1, "zero").where("w > 0").select("t.chan", "t.p", F.col("t.i").alias("to_i"), F.col("t.j").alias("to_j"), F.col("i").alias("a"), F.col("j").alias("b"), "w")
    return linear.apply_weights(images, w, ["chan", "p", "a", "b"], ["chan", "l", "to_i", "to_j"]).withColumnsRenamed({"to_i": "i", "to_j": "j"})


@register("back_projection", _IMAGES + "SELECT chan, l, i, j, round(v, 9) + 0.0 AS v FROM back WHERE abs(v) > 1e-9")
def back_projection(spark, d):
    """Each channel's samples on the sky, without merging channels; pixels of 0 are absent."""
    return _back(spark, d).where("abs(v) > 1e-9").select("chan", "l", "i", "j", (F.round("v", 9) + 0.0).alias("v"))


@register("channel_masks", _IMAGES + "SELECT chan, i, j FROM back WHERE l = 30 AND v > 12.05")
def channel_masks(spark, d):
    """Pixels of each channel where one wavelength's back-projection exceeds a threshold."""
    return _back(spark, d).where("l = 30 and v > 12.05").select("chan", "i", "j")


_TURNED = "cos(radians(8.2)) * (a - 5) - sin(radians(8.2)) * (b - 6) + (n - 1) / 2.0 AS x, sin(radians(8.2)) * (a - 5) + cos(radians(8.2)) * (b - 6) + 12 AS y"
_POINTS = ", points AS (SELECT a * 13 + b AS t, " + _TURNED + " FROM size, range(0, 11) AS u(a), range(0, 13) AS v(b))"


def _turned(spark, d):
    """A turned field of 11 by 13 samples about the middle of the grid, as targets (t, x, y)."""
    n = fx.rows_of(spark, d)
    t = spark.range(11 * 13).select(F.col("id").cast("int").alias("t"), F.expr("id div 13").alias("a"), (F.col("id") % 13).alias("b"))
    x, y = geo.to_global(F.col("a") - 5.0, F.col("b") - 6.0, 8.2, (F.lit((n - 1) / 2.0), F.lit(12.0)))
    return t.select("t", x.alias("x"), y.alias("y"))


@register("turned_gridding", fx.sql("cube", "size") + _POINTS + ", " + INSIDE.format(t="points") + "SELECT l, CAST(t AS INTEGER) AS t, round(sum(v * w), 6) + 0.0 AS v FROM cube JOIN weights USING (i, j) GROUP BY l, t")
def turned_gridding(spark, d):
    """A cube on a turned field; a sample outside the grid would raise."""
    w = linear.bilinear_weights(_turned(spark, d), 0.0, 1.0, fx.rows_of(spark, d), 0.0, 1.0, fx.COLUMNS)
    return linear.grid_forward(fx.cube(spark, d), w).select("l", "t", (F.round("v", 6) + 0.0).alias("v"))


@register("degridding", fx.sql("cube", "size") + """, local AS (SELECT l, i - 4 AS a, j - 6 AS b, v FROM cube WHERE i BETWEEN 4 AND 14 AND j BETWEEN 6 AND 18
), pixels AS (SELECT i, j, cos(radians(8.2)) * (i - (n - 1) / 2.0) + sin(radians(8.2)) * (j - 12) + 5 AS x, cos(radians(8.2)) * (j - 12) - sin(radians(8.2)) * (i - (n - 1) / 2.0) + 6 AS y FROM cube, size WHERE l = 0
), base AS (SELECT *, least(floor(x), 9) AS a0, least(floor(y), 11) AS b0 FROM pixels WHERE x >= 0 AND y >= 0 AND x <= 10 AND y <= 12
), found AS (SELECT l, base.i, base.j, sum(v * (CASE WHEN a = a0 THEN 1 - (x - a0) ELSE x - a0 END) * (CASE WHEN b = b0 THEN 1 - (y - b0) ELSE y - b0 END)) AS v FROM base JOIN local ON a BETWEEN a0 AND a0 + 1 AND b BETWEEN b0 AND b0 + 1 GROUP BY ALL)
SELECT l, i, j, round(coalesce(found.v, 0), 6) + 0.0 AS v FROM (SELECT l, i, j FROM cube) LEFT JOIN found USING (l, i, j)""")
def degridding(spark, d):
    """A field's samples read again on the sky's grid, 0 outside the field."""
    n = fx.rows_of(spark, d)
    c = fx.cube(spark, d)
    local = c.where("i between 4 and 14 and j between 6 and 18").select("l", (F.col("i") - 4).alias("a"), (F.col("j") - 6).alias("b"), "v")
    x, y = geo.to_local(F.col("i").cast("double"), F.col("j").cast("double"), 8.2, (F.lit((n - 1) / 2.0), F.lit(12.0)))
    pixels = c.where("l = 0").select((F.col("i") * fx.COLUMNS + F.col("j")).alias("t"), (x + 5).alias("x"), (y + 6).alias("y"))
    out = model.regridded(local, pixels, 0.0, 1.0, 11, 0.0, 1.0, 13)
    return out.select("l", F.expr(f"t div {fx.COLUMNS}").cast("int").alias("i"), (F.col("t") % fx.COLUMNS).cast("int").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


@register("coverage_mask", fx.sql("cube", "size") + _POINTS + """, hit AS (SELECT DISTINCT CAST(least(greatest(ceil(x - 0.5), 0), n - 1) AS INTEGER) AS i, CAST(least(greatest(ceil(y - 0.5), 0), 24) AS INTEGER) AS j FROM points, size)
SELECT DISTINCT CAST(i + a AS INTEGER) AS i, CAST(j + b AS INTEGER) AS j FROM hit, range(-1, 2) AS u(a), range(-1, 2) AS v(b), size WHERE i + a > 0 AND i + a < n - 1 AND j + b > 0 AND j + b < 24""")
def coverage_mask(spark, d):
    """Pixels nearest to a sample of a turned field, and their eight neighbours, off the border."""
    n = fx.rows_of(spark, d)
    return selection.dilate(model.covered(_turned(spark, d), 0.0, 1.0, n, 0.0, 1.0, fx.COLUMNS), n, fx.COLUMNS)


# Responses -----------------------------------------------------------------------------

@register("gaussian_psf", """WITH g AS (SELECT l, x, y, exp(-(power(-30 + x * (60.0 / 39), 2) + power(-30 + y * (60.0 / 39), 2)) / (2 * power((5 + 7.5 * l) * 1e-6 / 6.5 * 206265 / (0.025 * 2.354), 2))) AS w FROM range(0, 4) AS a(l), range(0, 40) AS b(x), range(0, 40) AS c(y))
SELECT CAST(l AS INTEGER) AS l, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(w / sum(w) OVER (PARTITION BY l), 9) AS w FROM g""")
def gaussian_psf(spark, d):
    waves = spark.range(4).select(F.col("id").cast("int").alias("l"), (5 + 7.5 * F.col("id")).alias("um"))
    return dense.gaussian_psf(waves, 0.025).withColumn("w", F.round("w", 9))


@register("transfer_blur", fx.sql("cube", "size") + """, g AS (SELECT x - 3 AS di, y - 3 AS dj, exp(-(power(x - 3, 2) + power(y - 3, 2)) / 8.0) AS w FROM range(0, 7) AS b(x), range(0, 7) AS c(y)
), k AS (SELECT di, dj, w / sum(w) OVER () AS w FROM g)
SELECT l, CAST((i + di + n) % n AS INTEGER) AS i, CAST((j + dj + 25) % 25 AS INTEGER) AS j, round(sum(v * w), 6) + 0.0 AS v FROM cube, k, size GROUP BY ALL""")
def transfer_blur(spark, d):
    """Blur by the transfer function of a wider Gaussian."""
    g = _grid(spark, d)
    at = np.arange(7) - 3.0
    psf = np.exp(-(at[:, None] ** 2 + at**2) / 8)
    blurred = schema.from_planes(dense.fft_blur(schema.planes(fx.cube(spark, d), grid=g), dense.transfer_function(psf / psf.sum(), (g.rows, g.columns)), g), g)
    reach = spark.range(psf.size).select(F.expr("id div 7 - 3").cast("int").alias("di"), (F.col("id") % 7 - 3).cast("int").alias("dj"), F.lit(1).alias("w"))
    return linear.only_reached(blurred, fx.pixels(spark, d), [reach], g).select("l", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@register("unmixed_blur", fx.sql("cube", "templates", "psf", "size") + ", b AS (SELECT l, CAST((i + di + n) % n AS INTEGER) AS i, CAST((j + dj + 25) % 25 AS INTEGER) AS j, sum(q * w) AS v FROM cube, psf, size GROUP BY ALL) SELECT m, i, j, CAST(sum(v * t) AS BIGINT) AS a FROM b JOIN templates USING (l) GROUP BY m, i, j")
def unmixed_blur(spark, d):
    """Inverse transform of blurred planes and the adjoint of mixing, in one pass over the planes."""
    c, g = fx.cube(spark, d), _grid(spark, d)
    rows = fx.templates(c).collect()  # one value a template and wavelength
    names = sorted({r.m for r in rows})
    s = np.zeros((len(names), fx.PLANES))
    for r in rows:
        s[names.index(r.m), r.l] = r.t
    kernel = np.zeros((g.rows, g.columns))
    for di, dj, w in fx.psf(spark).collect():
        kernel[di % g.rows, dj % g.columns] += w
    maps = schema.from_planes(dense.fft_unmix(schema.planes(c, "q", g), np.fft.rfft2(kernel), s, g), g)
    number = spark.createDataFrame(list(enumerate(names)), "l int, m int")
    return linear.only_reached(maps, fx.pixels(spark, d), [fx.psf(spark)], g).join(number, "l").select(F.col("m").cast("int").alias("m"), "i", "j", F.round("v").cast("long").alias("a"))


@register("dirac_response", fx.sql("wpsf") + "SELECT lp, l, b, CASE WHEN w = max(w) OVER (PARTITION BY lp, b) THEN 1 ELSE 0 END AS w FROM wpsf")
def dirac_response(spark, d):
    return dense.one_hot_response(fx.wpsf(spark))


@register("dirac_slices", fx.sql("cube", "wpsf") + ", one AS (SELECT lp, l, b, CASE WHEN w = max(w) OVER (PARTITION BY lp, b) THEN 1 ELSE 0 END AS w FROM wpsf) SELECT lp, i, j, CAST(sum(q * w) AS BIGINT) AS v FROM cube JOIN one ON one.l = cube.l AND b = j GROUP BY lp, i, j")
def dirac_slices(spark, d):
    """A cube through the one-hot response."""
    return linear.spectral_blur(fx.cube(spark, d), dense.one_hot_response(fx.wpsf(spark)), "q")


@register("slices_to_cube", fx.sql("cube", "wpsf", "slits") + """, y AS (SELECT j AS s, l AS lp, i, q AS v FROM cube WHERE l < 32 AND j < 7
), wide AS (SELECT s, count(*) AS k FROM slits GROUP BY s
), det AS (SELECT lp, i, j, sum(v / CAST(k AS DOUBLE)) AS v FROM y JOIN wide USING (s) JOIN slits USING (s) GROUP BY ALL)
SELECT wpsf.l AS l, i, j, round(sum(v * w) / sum(w), 6) + 0.0 AS v FROM det JOIN wpsf ON wpsf.lp = det.lp AND b = j GROUP BY ALL""")
def slices_to_cube(spark, d):
    """Real slices spread evenly over the columns of their slits, and averaged back to wavelengths."""
    y = fx.cube(spark, d).where(f"l < 32 and j < {SLITS}").select(F.col("j").alias("s"), F.col("l").alias("lp"), "i", F.col("q").alias("v"))
    slits = linear.slit_weights(spark, SLITS, WIDTH, 1).select("s", "j")
    wide = slits.groupBy("s").agg(F.count("*").alias("k"))
    spread = y.join(wide, "s").join(slits, "s").groupBy("lp", "i", "j").agg(F.sum(F.col("v") / F.col("k")).alias("v"))
    return linear.spread_average(spread, fx.wpsf(spark)).select("l", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@register("diffracted_psf", fx.sql("cube", "templates", "wpsf") + """, s AS (SELECT l, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, 1 + (l + a * b) % 5 AS w FROM range(0, 64) AS p(l), range(0, 9) AS u(a), range(0, 9) AS v(b)
) SELECT lp, a, s.b AS b, CAST(sum(s.w * t * wpsf.w) AS BIGINT) AS v FROM s JOIN templates ON templates.l = s.l AND m = 3 JOIN wpsf ON wpsf.l = s.l AND wpsf.b = s.b GROUP BY lp, a, s.b""")
def diffracted_psf(spark, d):
    psf = spark.range(fx.PLANES * 81).select(F.expr("id div 81").cast("int").alias("l"), F.expr("id % 81 div 9").cast("int").alias("a"), (F.col("id") % 9).cast("int").alias("b"))
    psf = psf.withColumn("w", 1 + (F.col("l") + F.col("a") * F.col("b")) % 5)
    return model.diffracted(psf, fx.templates(fx.cube(spark, d)).where("m = 3").select("l", "t"), fx.wpsf(spark)).withColumn("v", F.col("v").cast("long"))


_SHARE = "share AS (SELECT CAST(l AS INTEGER) AS l, 2 + l % 3 AS w FROM range(0, 64) AS r(l))"


def _through(spark, d):
    share = spark.range(fx.PLANES).select(F.col("id").cast("int").alias("l"), (2 + F.col("id") % 3).alias("w"))
    return model.throughput(share) @ model.blur(fx.psf(spark), _grid(spark, d)) @ model.mixing(fx.templates(fx.cube(spark, d)))


@register("throughput_forward", fx.sql("cube", "templates", "maps", "psf", "size") + ", " + _SHARE + ", mixed AS (SELECT l, i, j, sum(a * t) AS v FROM maps JOIN templates USING (m) GROUP BY l, i, j), blurred AS (" + _BLUR.format(of="mixed") + ") SELECT l, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(v * w AS BIGINT) AS v FROM blurred JOIN share USING (l)")
def throughput_forward(spark, d):
    """Throughput, blur and mixing."""
    return _through(spark, d).forward(fx.maps(fx.cube(spark, d)).withColumnRenamed("a", "v"))


@register("throughput_adjoint", fx.sql("cube", "templates", "psf", "size") + ", " + _SHARE + ", scaled AS (SELECT l, i, j, q * w AS v FROM cube JOIN share USING (l)), unblurred AS (SELECT l, (i - di + n) % n AS i, (j - dj + 25) % 25 AS j, sum(v * psf.w) AS v FROM scaled, psf, size GROUP BY ALL) SELECT m, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(sum(v * t) AS BIGINT) AS v FROM unblurred JOIN templates USING (l) GROUP BY m, i, j")
def throughput_adjoint(spark, d):
    return _through(spark, d).adjoint(fx.cube(spark, d).select("l", "i", "j", F.col("q").alias("v")))


# Geometry of instruments -----------------------------------------------------------------

_WIDTHS = "(VALUES " + ", ".join(f"('{b}', {v[0]}, CAST({v[3]} AS DOUBLE){{u}}, CAST({v[4]} AS DOUBLE){{u}}, CAST({v[5]} AS DOUBLE){{u}})" for b, v in geo.BANDS.items()) + ") AS t(chan, n, pix, fa, fb)"
_STEP = "(CAST(0.025 AS DOUBLE) / 3600)"
_BEGIN = "(floor((-{w} / CAST(2 AS DOUBLE) - 5 * " + _STEP + ") / " + _STEP + ") * " + _STEP + ")"


@register("detector_shapes", "WITH b AS (SELECT *, " + _STEP + " + " + _BEGIN.format(w="fa") + " - " + _BEGIN.format(w="fa") + " AS ha, " + _STEP + " + " + _BEGIN.format(w="fb") + " - " + _BEGIN.format(w="fb") + " AS hb FROM " + _WIDTHS.format(u=" / 3600") + """
), c AS (SELECT chan, CAST(floor(pix / """ + _STEP + """) AS INTEGER) AS factor, CAST(ceil(fa / 2 / ha) - floor(-fa / 2 / ha) AS INTEGER) AS pixels, CAST(ceil(fb / n / hb) AS INTEGER) AS columns FROM b)
SELECT chan, factor, pixels, CAST(ceil(pixels / CAST(factor AS DOUBLE)) AS INTEGER) AS samples, columns FROM c""")
def detector_shapes(spark, d):
    return geo.detector_shapes(spark)


_CUSTOMERS = "pts AS (SELECT CAST(c_custkey % 41 AS DOUBLE) / 10 - 2 AS alpha, CAST(c_custkey % 29 AS DOUBLE) / 10 - 1.4 AS beta FROM customer)"


@register("view_of_all", "WITH " + _CUSTOMERS + ", f AS (SELECT chan, min(c * x - s * -y) AS a0, max(c * x + s * y) AS a1, min(c * y - s * x) AS b0, max(c * y - s * x) AS b1 FROM (SELECT chan, fa / 2 * u AS x, fb / 2 * v AS y, cos(radians(8.2)) AS c, sin(radians(8.2)) AS s FROM " + _WIDTHS.format(u="") + """, (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1)) AS k(u, v)) GROUP BY chan)
SELECT round(min(a0) - (SELECT min(alpha) FROM pts) - 5, 6) AS alpha0, round(min(b0) - (SELECT min(beta) FROM pts) - 5, 6) AS beta0, round(max(a1) + (SELECT max(alpha) FROM pts) + 5, 6) AS alpha1, round(min(b1) + (SELECT max(beta) FROM pts) + 5, 6) AS beta1 FROM f""")
def view_of_all(spark, d):
    k = F.col("c_custkey")
    pointings = fx.table(spark, d, "customer").select(((k % 41).cast("double") / 10 - 2).alias("alpha"), ((k % 29).cast("double") / 10 - 1.4).alias("beta"))
    box = geo.field_box(F.col("alpha_width"), F.col("beta_width"), 8.2, (F.lit(0.0), F.lit(0.0)))
    out = geo.view_of_all(pointings, geo.instruments(spark).select("chan", *[c.alias(n) for n, c in box.items()]))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("wavelength_properties", "SELECT o_orderkey AS t, (o_orderkey % 3) * 0.5 + 4.9 AS wavel_min, (o_orderkey % 7 + o_orderkey % 3) * 0.5 + 4.9 AS wavel_max, CASE WHEN o_orderkey % 7 > 0 THEN 0.5 END AS wavel_step, CAST(1 + o_orderkey % 7 AS INTEGER) AS n_wavel FROM orders")
def wavelength_properties(spark, d):
    k = F.col("o_orderkey")
    axis = fx.table(spark, d, "orders").select(k.alias("t"), geo.axis_from_header(1 + k % 7, 1 + k % 3, F.lit(0.5), F.lit(4.9)).alias("axis"))
    return axis.select("t", *[(F.round(c, 6) if n != "n_wavel" else c).alias(n) for n, c in geo.wavelength_properties(F.col("axis")).items()])


@register("pixel_names", _FILES + "SELECT name, CASE WHEN ends_with(stem, 'pix') THEN stem ELSE stem || '_pix' END AS pix FROM (SELECT name, replace(name, '.fits', CASE WHEN CAST(a * 8 AS BIGINT) % 2 = 0 THEN '_pix' ELSE '' END) AS stem FROM f)")
def pixel_names(spark, d):
    stem = F.regexp_replace("name", "\\.fits", F.when((F.col("a") * 8).cast("long") % 2 == 0, F.lit("_pix")).otherwise(F.lit("")))
    return _files(spark, d).select("name", headers.pixel_name(stem).alias("pix"))


_CORRECTED = "(VALUES " + ", ".join(f"({c}, {', '.join(map(str, v))})" for c, v in headers.CORRECTED.items()) + ") AS t(channel, n, pix, fa, fb, turn)"


@register("corrected_instrument", "SELECT c_custkey AS t, channel || chr(CAST(97 + c_custkey // 4 % 3 AS INTEGER)) AS chan, n AS n_slit, CAST(pix AS DOUBLE) AS det_pix, CAST(fa AS DOUBLE) AS alpha_width, CAST(fb AS DOUBLE) AS beta_width, round(turn + CAST(c_custkey AS DOUBLE) / 8, 6) AS angle FROM customer JOIN " + _CORRECTED + " ON channel = 1 + c_custkey % 4")
def corrected_instrument(spark, d):
    """Instruments of corrected files, from their headers' channel, band and position angle."""
    k = F.col("c_custkey")
    named = fx.table(spark, d, "customer").select(k.alias("t"), (1 + k % 4).alias("CHANNEL"), F.element_at(F.array(*map(F.lit, headers.LETTERS)), (1 + F.expr("c_custkey div 4") % 3).cast("int")).alias("BAND"), (k.cast("double") / 8).alias("PA_V3"))
    return headers.corrected_instrument(named).select("t", "chan", "n_slit", "det_pix", "alpha_width", "beta_width", F.round("angle", 6).alias("angle"))


# Order and layout ----------------------------------------------------------------------

@register("reversed_blocks", fx.sql("cube") + "SELECT CAST((15 - l // 4) * 4 + l % 4 AS INTEGER) AS l, i, j, q FROM cube")
def reversed_blocks(spark, d):
    return ordered.reverse_blocks(fx.cube(spark, d).select("l", "i", "j", "q"), "l", 4, 16)


@register("side_by_side", fx.sql("cube") + "SELECT l, i, j, q FROM cube UNION ALL SELECT l, i, CAST(j + 25 AS INTEGER), -q FROM cube")
def side_by_side(spark, d):
    c = fx.cube(spark, d).select("l", "i", "j", "q")
    return ordered.side_by_side([(c, fx.COLUMNS), (c.withColumn("q", -F.col("q")), fx.COLUMNS)], "j")


@register("blocks", fx.sql("cube") + "SELECT CAST(i // 4 AS INTEGER) AS bi, CAST(j // 4 AS INTEGER) AS bj, CAST(sum(q * (1 + i % 4 * 4 + j % 4)) AS BIGINT) AS s, count(*) AS n FROM cube GROUP BY 1, 2")
def blocks(spark, d):
    """Blocks of four by four pixels, weighted by the place within them."""
    c = ordered.from_blocks(ordered.into_blocks(fx.cube(spark, d).select("l", "i", "j", "q"), 4), 4)
    return ordered.into_blocks(c, 4).groupBy("bi", "bj").agg(F.sum(F.col("q") * (1 + F.col("i") * 4 + F.col("j"))).alias("s"), F.count("*").alias("n"))


@register("gray_image", fx.sql("cube") + "SELECT i, j, round(sum(v * CASE l WHEN 0 THEN 0.2125 WHEN 1 THEN 0.7154 ELSE 0.0721 END), 6) + 0.0 AS v FROM cube WHERE l < 3 GROUP BY i, j")
def gray_image(spark, d):
    return metrics.gray(fx.cube(spark, d)).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@register("scattered_nearest", fx.sql("cube") + ", s AS (SELECT i * 25 + j AS id, i + j % 3 * 0.2 AS sx, j + i % 4 * 0.15 AS sy FROM cube WHERE l = 0), t AS (SELECT i * 25 + j AS t, i + 0.37 AS x, j + 0.21 AS y FROM cube WHERE l = 0) SELECT t, arg_min(id, {'d': round(power(x - sx, 2) + power(y - sy, 2), 9), 'id': id}) AS id FROM t, s GROUP BY t")
def scattered_nearest(spark, d):
    """The number of the scattered sample nearest to each target."""
    p = fx.cube(spark, d).where("l = 0").withColumn("k", (F.col("i") * fx.COLUMNS + F.col("j")).cast("int"))
    samples = p.select(F.col("k").alias("id"), (F.col("i") + F.col("j") % 3 * 0.2).alias("sx"), (F.col("j") + F.col("i") % 4 * 0.15).alias("sy"))
    return neighbours.nearest_sample(p.select(F.col("k").alias("t"), (F.col("i") + 0.37).alias("x"), (F.col("j") + 0.21).alias("y")), samples, 1.0)


# Files, fields and channels ------------------------------------------------------------

_HEADERS = _FILES + """, h AS (SELECT name, CAST(a * 8 AS BIGINT) AS k FROM f), b AS (SELECT * FROM (VALUES """ + ", ".join(f"('{b}', {v[0]})" for b, v in geo.BANDS.items()) + ") AS t(chan, n)), turn AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {v[4]})" for c, v in headers.CORRECTED.items()) + ") AS t(c, turn)) "


@register("file_observations", _HEADERS + """SELECT name, chan, CAST(n AS INTEGER) AS n_slit, CAST(1 + k % 5 AS INTEGER) AS n_wavel, 4.9 + (k % 3) * 0.5 AS wavel_min, CAST(k AS DOUBLE) / 16 AS alpha, 0 - CAST(k AS DOUBLE) / 32 AS beta, round(turn + k % 360, 6) AS angle
FROM h JOIN b ON chan = regexp_extract(name, 'ch([1-4][abc])', 1) JOIN turn ON c = substr(chan, 1, 1)""")
def file_observations(spark, d):
    """Files with instrument, axis, target and angle, all from name and header."""
    k = (F.col("a") * 8).cast("long")
    rows = _files(spark, d).select("name", (1 + k % 5).alias("NAXIS3"), (1 + k % 3).alias("CRPIX3"), F.lit(0.5).alias("CDELT3"), F.lit(4.9).alias("CRVAL3"), (k / 16.0).alias("RA_V1"), (-k / 32.0).alias("DEC_V1"), (k % 360).cast("double").alias("PA_V3"))
    return headers.observations(rows).select("name", "chan", F.col("n_slit").cast("int").alias("n_slit"), F.size("axis").alias("n_wavel"), F.round(F.col("axis")[0], 6).alias("wavel_min"), "alpha", "beta", F.round("angle", 6).alias("angle"))


@register("shifted_fields", "WITH " + _CUSTOMERS.replace("SELECT", "SELECT c_custkey AS t,", 1) + """, c AS (SELECT t, cos(radians(8.2)) * x + sin(radians(8.2)) * y + alpha - 0.25 AS a, cos(radians(8.2)) * y - sin(radians(8.2)) * x + beta + 0.5 AS b FROM pts, (VALUES (-1.6, -1.85), (1.6, -1.85), (1.6, 1.85), (-1.6, 1.85)) AS k(x, y))
SELECT t, round(min(a), 6) AS a0, round(max(a), 6) AS a1, round(min(b), 6) AS b0, round(max(b), 6) AS b1 FROM c GROUP BY t""")
def shifted_fields(spark, d):
    """The first band's field at each pointing, less a common offset."""
    k = F.col("c_custkey")
    at = fx.table(spark, d, "customer").select(k.alias("t"), ((k % 41).cast("double") / 10 - 2 - 0.25).alias("alpha"), ((k % 29).cast("double") / 10 - 1.4 + 0.5).alias("beta"))
    return at.select("t", *[F.round(c, 6).alias(n) for n, c in geo.field_box(F.lit(3.2), F.lit(3.7), 8.2, (F.col("alpha"), F.col("beta"))).items()])


@register("channel_wavelengths", fx.sql("cube") + """, x AS (SELECT l, 5 + 0.25 * l AS x FROM range(0, 64) AS r(l)), cut AS (SELECT c, (SELECT l FROM x ORDER BY abs(x - c), l LIMIT 1) AS l FROM (VALUES (7.55), (11.63), (17.8)) AS t(c)
), m AS (SELECT x.l, 1 + count(cut.l) AS chan FROM x LEFT JOIN cut ON x.l >= cut.l GROUP BY x.l) SELECT CAST(m.chan AS INTEGER) AS chan, cube.l, i, j, CASE WHEN mask.c IS NULL THEN 0 ELSE q END AS q FROM cube JOIN m ON m.l = cube.l LEFT JOIN (SELECT unnest([1, 2, 3]) AS c) mask ON mask.c = m.chan""")
def channel_wavelengths(spark, d):
    """Wavelengths by channel, cut at the samples nearest to fixed wavelengths; the last channel is masked out."""
    axis = spark.range(fx.PLANES).select(F.col("id").cast("int").alias("idx"), (5 + 0.25 * F.col("id")).alias("x"))
    cuts = spark.createDataFrame([(0, 7.55), (1, 11.63), (2, 17.8)], "t int, x double")
    return selection.by_channel(fx.cube(spark, d).select("l", "i", "j", "q"), neighbours.nearest_on_axis(cuts, axis), [1, 2, 3], "q")


@register("channel_rolls", fx.sql("cube") + "SELECT CAST(1 + l // 16 AS INTEGER) AS chan, CAST(CASE l // 16 WHEN 0 THEN (l % 16 + 10) % 16 WHEN 1 THEN (l % 16 + 9) % 16 ELSE l % 16 END AS INTEGER) AS s, i, j, q FROM cube")
def channel_rolls(spark, d):
    """Slices rolled by their channel's own number of places."""
    c = fx.cube(spark, d).select((F.floor(F.col("l") / 16) + 1).cast("int").alias("chan"), (F.col("l") % 16).cast("int").alias("s"), "i", "j", "q")
    return ordered.rolled(c, "chan", "s", {1: 10, 2: 9}, 16)


@register("stuffed", fx.sql("cube", "templates") + ", z AS (SELECT m, k, CASE WHEN k % 3 = 0 THEN t ELSE 0 END AS t FROM templates JOIN (SELECT k, k // 3 AS l FROM range(0, 192) AS r(k)) USING (l)) SELECT m, CAST(k AS INTEGER) AS l, CAST(sum(t) OVER (PARTITION BY m ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS t FROM z")
def stuffed(spark, d):
    """Templates at three times the samples: zeros between, then a centred box kernel."""
    return ordered.stuffed(fx.templates(fx.cube(spark, d)), "m", "l", "t", 3)


_WAVES = "x AS (SELECT l, CAST(7.5 AS DOUBLE) + 0.004 * l AS x FROM range(-14, 78) AS r(l)), y AS (SELECT lp, CAST(7.52 AS DOUBLE) + 0.008 * lp AS y FROM range(0, 30) AS r(lp))"


@register("instrument_response", "WITH " + _WAVES + """, z AS (SELECT lp, l, b, pi() * pi() * 3050 * (y - x - (0.008 / 0.196) * ((b - 3) * 0.025)) / y AS z FROM x, y, range(0, 7) AS r(b)
), v AS (SELECT lp, l, b, CASE WHEN abs(z) < 1e-12 THEN 1.0 ELSE power(sin(z) / z, 2) END AS v FROM z)
SELECT CAST(lp AS INTEGER) AS lp, CAST(l AS INTEGER) AS l, CAST(b AS INTEGER) AS b, w FROM (SELECT *, round(v / sum(v) OVER (PARTITION BY lp, b), 9) AS w FROM v) WHERE l BETWEEN 0 AND 63""")
def instrument_response(spark, d):
    """A band's response: columns about the middle of the slit, shifted by the detector's step over its pixel."""
    band = geo.BANDS["2a"]
    axis = lambda n, name, at, first, step: spark.range(n).select(F.col("id").cast("int").alias(name), (F.lit(float(first)) + F.col("id") * step).alias(at))
    beta = spark.range(7).select(F.col("id").cast("int").alias("b"), ((F.col("id") - 3) * 0.025).alias("beta"))
    w = dense.spectral_response(axis(64, "l", "x", 7.5, 0.004), axis(30, "lp", "y", 7.52, 0.008), beta, (band[1] + band[2]) / 2, 0.008 / band[3])
    return w.select("lp", "l", "b", F.round("w", 9).alias("w"))


# Files as tables --------------------------------------------------------------------------

#: Planes and rows of the grid in one file, so that files stay small however large the cube is.
_DEPTH, _ROWS = 16, 256


def _cubes(spark, d):
    """The cube as files of sixteen planes and 256 rows, named by both."""
    l, i = F.col("l"), F.col("i")
    path = F.concat_ws("_", F.lit("cube"), F.floor(l / _DEPTH), F.floor(i / _ROWS))
    return fx.cube(spark, d).select(path.alias("path"), (l % _DEPTH).alias("l"), (i % _ROWS).alias("i"), "j", "v")


def _joined(voxels):
    """Voxels of such files at their places in the whole cube."""
    at = F.split("path", "_")
    return voxels.select((at[1].cast("int") * _DEPTH + F.col("l")).alias("l"), (at[2].cast("int") * _ROWS + F.col("i")).alias("i"), "j", "v")


@register("fits_cube", fx.sql("cube") + "SELECT l, i, j, v FROM cube")
def fits_cube(spark, d):
    """The cube written as FITS files and read again."""
    units = files.fits_units(files.packed_cubes(_cubes(spark, d))).where("unit = 1")
    return _joined(files.unfolded(units))


@register("npy_cube", fx.sql("cube") + "SELECT l, i, j, v FROM cube")
def npy_cube(spark, d):
    return _joined(files.unfolded(files.npy_arrays(files.packed_cubes(_cubes(spark, d), "npy"))))


@register("fits_targets", "SELECT 'f' || c_custkey AS path, CAST(c_custkey AS DOUBLE) / 16 AS alpha, 0 - CAST(c_custkey AS DOUBLE) / 32 AS beta, CAST(c_custkey AS DOUBLE) / 8 AS corrected_alpha, 0 - CAST(c_custkey AS DOUBLE) / 64 AS corrected_beta FROM customer")
def fits_targets(spark, d):
    """Targets of raw and of corrected files, from the names that each kind of header has."""
    k = F.col("c_custkey").cast("double")
    rows = fx.table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), (k / 16).alias("RA_V1"), (0.0 - k / 32).alias("DEC_V1"), (k / 8).alias("TARG_RA"), (0.0 - k / 64).alias("TARG_DEC"))
    units = files.fits_units(files.packed_headers(rows, ["RA_V1", "DEC_V1", "TARG_RA", "TARG_DEC"]))
    corrected = files.header_target(units, 0, "TARG_RA", "TARG_DEC").withColumnsRenamed({"alpha": "corrected_alpha", "beta": "corrected_beta"})
    return files.header_target(units, 1, "RA_V1", "DEC_V1").join(corrected, "path")


@register("assembled_slices", """WITH f AS (SELECT chan, p, k, CASE WHEN k % 17 = 0 THEN NULL ELSE CAST((k * 7 + p * 13) % 101 AS DOUBLE) END AS y FROM (VALUES ('1a'), ('3c')) AS t(chan), range(0, 8) AS u(p), range(0, 60) AS v(k))
SELECT chan, CAST(p AS INTEGER) AS p, CAST(k // 4 % 3 AS INTEGER) AS s, CAST(k // 12 AS INTEGER) AS lp, CAST(k % 4 AS INTEGER) AS a, y FROM f""")
def assembled_slices(spark, d):
    """Files of [lambda, slit, alpha] by band and in order of name, as slices."""
    k = F.sequence(F.lit(0), F.lit(59))
    named = spark.range(16).select(F.when(F.col("id") < 8, "1a").otherwise("3c").alias("chan"), (F.col("id") % 8).alias("p"))
    data = F.transform(k, lambda x: F.when(x % 17 == 0, float("nan")).otherwise(((x * 7 + F.col("p") * 13) % 101).cast("double")))
    arrays = named.select(F.concat(F.lit("in/x_ch"), "chan", F.lit("_0"), F.col("p").cast("string"), F.lit(".npy")).alias("path"), F.array(F.lit(5), F.lit(3), F.lit(4)).alias("shape"), data.alias("data"))
    return headers.assembled(arrays).select("chan", F.col("p").cast("int").alias("p"), "s", "lp", F.col("a").cast("int").alias("a"), "y")


@register("scene_maps", fx.sql("cube", "templates", "maps", "size") + """, small AS (SELECT m, CAST(ceil(i / 4.0) AS INTEGER) AS i, CAST(ceil(j / 4.0) AS INTEGER) AS j, sum(a) / 16.0 AS a FROM maps GROUP BY ALL), e AS (SELECT n, ((n + 3) // 4 - 4 + 1) // 2 AS first FROM size)
SELECT m, CAST(i - first AS INTEGER) AS i, CAST(j - 2 AS INTEGER) AS j, a FROM small, e WHERE i * 4 < n AND j * 4 < 25 AND i >= first AND i < first + 4 AND j >= 2 AND j < 6""")
def scene_maps(spark, d):
    """Maps averaged over four pixels a side, and their middle."""
    c = fx.cube(spark, d)
    return simulation.scene(fx.maps(c), fx.templates(c), fx.rows_of(spark, d), fx.COLUMNS, 4, 4)[0].select("m", "i", "j", "a")


@register("flux_scaled", fx.sql("cube", "slits", "size") + "SELECT j AS s, l AS lp, i, round(q * tw * 3, 6) AS v FROM cube JOIN (SELECT s, sum(w) AS tw FROM slits WHERE j < 24 GROUP BY s) t ON t.s = j WHERE l < 32")
def flux_scaled(spark, d):
    """Samples per solid angle as flux, for the solver."""
    slits = linear.slit_weights(spark, SLITS, WIDTH, 2).where(f"j < {fx.COLUMNS - 1}").select(F.lit("a").alias("chan"), "s", F.col("i").alias("a"), F.col("j").alias("b"), "w")
    samples = fx.cube(spark, d).where(f"l < 32 and j < {SLITS}").select(F.lit("a").alias("chan"), F.col("j").alias("s"), F.col("l").alias("lp"), "i", F.col("q").alias("v"))
    return fusion.to_flux(samples, slits, FACTOR).select("s", "lp", "i", F.round("v", 6).alias("v"))

"""Queries of the cube operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave import schema
from specweave.functions import geometry as geo
from specweave.operators import dense, linear, metrics, neighbours, ordered, selection
from specweave.plans import fixtures as fx
from specweave.plans import solvers
from specweave.plans.registry import register
from specweave.runtime import materialize

GRID = """axis AS (SELECT CAST(k AS INTEGER) AS idx, 5.0 + 0.01 * k AS x FROM range(0, 64) AS r(k))"""


def _axis(spark: SparkSession) -> DataFrame:
    return spark.range(fx.PLANES).select(F.col("id").cast("int").alias("idx"), (F.lit(5.0) + 0.01 * F.col("id")).alias("x"))


def _grid(spark: SparkSession, d: str) -> schema.GridSpec:
    return schema.GridSpec(fx.rows_of(spark, d), fx.COLUMNS, fx.PLANES)


# Mixing ----------------------------------------------------------------------

@register("lmm_cube2maps", fx.sql("cube", "templates", "maps") + "SELECT m, i, j, a FROM maps")
def lmm_cube2maps(spark, d):
    return fx.maps(fx.cube(spark, d))


@register("lmm_maps2cube", fx.sql("cube", "templates", "maps") + "SELECT l, i, j, CAST(sum(a * t) AS BIGINT) AS v FROM maps JOIN templates USING (m) GROUP BY l, i, j")
def lmm_maps2cube(spark, d):
    c = fx.cube(spark, d)
    return linear.mix_maps(fx.maps(c), fx.templates(c))


@register("dominant_template", fx.sql("cube", "templates", "maps") + "SELECT i, j, m FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY a DESC, m) AS r FROM maps) WHERE r = 1")
def dominant_template(spark, d):
    return fx.maps(fx.cube(spark, d)).groupBy("i", "j").agg(F.max_by("m", F.struct("a", -F.col("m"))).alias("m"))


@register("normal_matrix", fx.sql("cube", "templates") + "SELECT p.m AS m1, q.m AS m2, CAST(sum(p.t * q.t) AS BIGINT) AS g FROM templates p JOIN templates q USING (l) GROUP BY p.m, q.m")
def normal_matrix(spark, d):
    t = fx.templates(fx.cube(spark, d))
    upper = t.withColumnRenamed("m", "m1").join(t.select(F.col("m").alias("m2"), "l", F.col("t").alias("u")), "l").where("m1 <= m2").groupBy("m1", "m2").agg(F.sum(F.col("t") * F.col("u")).alias("g"))
    return upper.union(upper.where("m1 < m2").select("m2", "m1", "g"))


@register("median_normalised_templates", fx.sql("cube", "templates") + "SELECT m, l, round(t / nullif(md, 0), 6) + 0.0 AS t FROM templates JOIN (SELECT m, median(CAST(t AS DOUBLE)) AS md FROM templates GROUP BY m) USING (m)")
def median_normalised_templates(spark, d):
    t = fx.templates(fx.cube(spark, d))
    return t.join(t.groupBy("m").agg(F.median("t").alias("md")), "m").select("m", "l", (F.round(F.try_divide(F.col("t").cast("double"), "md"), 6) + 0.0).alias("t"))


# Blur, response, decimation, slicing ------------------------------------------

_CONV = "SELECT l, CAST((i + {s}di + n) % n AS INTEGER) AS i, CAST((j + {s}dj + 25) % 25 AS INTEGER) AS j, CAST(sum(q * w) AS BIGINT) AS v FROM cube, psf, size GROUP BY ALL"


@register("circ_conv", fx.sql("cube", "psf", "size") + _CONV.format(s=""))
def circ_conv(spark, d):
    return linear.circular_blur(fx.cube(spark, d), fx.psf(spark), _grid(spark, d), "q")


@register("circ_conv_adj", fx.sql("cube", "psf", "size") + _CONV.format(s="-"))
def circ_conv_adj(spark, d):
    return linear.circular_blur(fx.cube(spark, d), fx.psf(spark), _grid(spark, d), "q", transposed=True)


@register("fft_conv", fx.sql("cube", "psf", "size") + "SELECT l, i, j, CAST(v AS DOUBLE) + 0.0 AS v FROM (" + _CONV.format(s="") + ")")
def fft_conv(spark, d):
    g = _grid(spark, d)
    kernel = np.zeros((g.rows, g.columns))
    for di, dj, w in fx.psf(spark).collect():
        kernel[di % g.rows, dj % g.columns] += w
    blurred = schema.from_planes(dense.fft_blur(schema.planes(fx.cube(spark, d), "q", g), np.fft.rfft2(kernel), g), g)
    return linear.only_reached(blurred, fx.pixels(spark, d), [fx.psf(spark)], g).select("l", "i", "j", (F.round("v") + 0.0).alias("v"))


@register("wblur", fx.sql("cube", "wpsf") + "SELECT lp, i, j, CAST(sum(q * w) AS BIGINT) AS v FROM cube JOIN wpsf ON wpsf.l = cube.l AND b = j GROUP BY lp, i, j")
def wblur(spark, d):
    return linear.spectral_blur(fx.cube(spark, d), fx.wpsf(spark), "q")


@register("wblur_beta_sum", fx.sql("cube", "wpsf") + "SELECT lp, i, CAST(sum(q * w) AS BIGINT) AS v FROM cube JOIN wpsf ON wpsf.l = cube.l AND b = j GROUP BY lp, i")
def wblur_beta_sum(spark, d):
    return linear.spectral_blur(fx.cube(spark, d), fx.wpsf(spark), "q", sum_columns=True)


_DET = ", det AS (SELECT l AS lp, i, j, q AS y FROM cube WHERE l < 32) "


@register("wblur_t", fx.sql("cube", "wpsf") + _DET + "SELECT wpsf.l AS l, i, j, CAST(sum(y * w) AS BIGINT) AS v FROM det JOIN wpsf ON wpsf.lp = det.lp AND b = j GROUP BY ALL")
def wblur_t(spark, d):
    det = fx.cube(spark, d).where("l < 32").select(F.col("l").alias("lp"), "i", "j", F.col("q").alias("y"))
    return linear.spectral_blur_adjoint(det, fx.wpsf(spark), "y")


@register("slice_avg", fx.sql("cube", "wpsf") + _DET + "SELECT wpsf.l AS l, i, j, round(CAST(sum(y * w) AS DOUBLE) / sum(w), 6) AS v FROM det JOIN wpsf ON wpsf.lp = det.lp AND b = j GROUP BY ALL")
def slice_avg(spark, d):
    det = fx.cube(spark, d).where("l < 32").select(F.col("l").alias("lp"), "i", "j", F.col("q").alias("y"))
    return linear.spread_average(det, fx.wpsf(spark), "y").withColumn("v", F.round("v", 6))


@register("box_decimate", fx.sql("cube", "size") + "SELECT l, CAST(i // 3 AS INTEGER) AS a, j, CAST(sum(q) AS BIGINT) AS v FROM cube, size WHERE i < 3 * (n // 3) GROUP BY ALL")
def box_decimate(spark, d):
    return linear.box_decimate(fx.cube(spark, d), 3, fx.rows_of(spark, d) // 3, "q")


@register("slicing", fx.sql("cube", "slits") + "SELECT s, l, i, j, q * w AS v FROM cube JOIN slits USING (j)")
def slicing(spark, d):
    return linear.slice_forward(fx.cube(spark, d), linear.slit_weights(spark, 7, 3.5, fx.rows_of(spark, d)), "q")


@register("slicing_adj", fx.sql("cube", "slits") + "SELECT l, i, j, sum(q * w * w) AS v FROM cube JOIN slits USING (j) GROUP BY l, i, j")
def slicing_adj(spark, d):
    slits = linear.slit_weights(spark, 7, 3.5, fx.rows_of(spark, d))
    return linear.slice_adjoint(linear.slice_forward(fx.cube(spark, d), slits, "q"), slits)


_TARGETS = ", targets AS (SELECT CAST(k AS INTEGER) AS t, (k % 19) * 0.5 AS x, (k // 19) * 0.75 AS y FROM range(0, 400) AS r(k)) "
_BILINEAR = (
    _TARGETS
    + """, base AS (SELECT t, x, y, CAST(least(floor(x), n - 2) AS INTEGER) AS i0, CAST(least(floor(y), 23) AS INTEGER) AS j0 FROM targets, size
), weights AS (
    SELECT t, i0 + a AS i, j0 + b AS j,
           (CASE WHEN a = 1 THEN x - i0 ELSE 1 - (x - i0) END) * (CASE WHEN b = 1 THEN y - j0 ELSE 1 - (y - j0) END) AS w
    FROM base, range(0, 2) AS p(a), range(0, 2) AS r(b)) """
)


def _targets(spark: SparkSession) -> DataFrame:
    return spark.range(400).select(F.col("id").cast("int").alias("t"), (F.col("id") % 19 * 0.5).alias("x"), (F.expr("id div 19") * 0.75).alias("y"))


def _bilinear(spark: SparkSession, d: str) -> DataFrame:
    return linear.bilinear_weights(_targets(spark), 0.0, 1.0, fx.rows_of(spark, d), 0.0, 1.0, fx.COLUMNS)


@register("bilinear_gridding", fx.sql("cube", "size") + _BILINEAR + "SELECT l, t, CAST(sum(q * w) AS DOUBLE) AS v FROM cube JOIN weights USING (i, j) GROUP BY l, t")
def bilinear_gridding(spark, d):
    return linear.grid_forward(fx.cube(spark, d), _bilinear(spark, d), "q")


@register("bilinear_adj", fx.sql("cube", "size") + _BILINEAR + "SELECT l, CAST(w2.i AS INTEGER) AS i, CAST(w2.j AS INTEGER) AS j, CAST(sum(g.v * w2.w) AS DOUBLE) AS v FROM (SELECT l, t, sum(q * w) AS v FROM cube JOIN weights USING (i, j) GROUP BY l, t) g JOIN weights w2 USING (t) GROUP BY ALL")
def bilinear_adj(spark, d):
    w = _bilinear(spark, d)
    return linear.grid_adjoint(linear.grid_forward(fx.cube(spark, d), w, "q"), w)


@register("nn_gridding", fx.sql("cube", "size") + _TARGETS + "SELECT l, t, q AS v FROM targets, size JOIN cube ON cube.i = least(greatest(ceil(x - 0.5), 0), n - 1) AND cube.j = least(greatest(ceil(y - 0.5), 0), 24)")
def nn_gridding(spark, d):
    w = linear.nearest_weights(_targets(spark), 0.0, 1.0, fx.rows_of(spark, d), 0.0, 1.0, fx.COLUMNS)
    return linear.grid_forward(fx.cube(spark, d), w, "q").withColumn("v", F.col("v").cast("long"))


@register("filter_integrate", fx.sql("cube") + "SELECT i, j, round(sum(v * CASE WHEN l <= 20 THEN l / 20.0 WHEN l <= 50 THEN 1 - (l - 20) / 30.0 ELSE 0 END), 6) AS v FROM cube GROUP BY i, j")
def filter_integrate(spark, d):
    axis = spark.range(fx.PLANES).select(F.col("id").cast("int").alias("l"), F.col("id").cast("double").alias("x"))
    points = spark.createDataFrame([(0.0, 0.0), (20.0, 1.0), (50.0, 0.0)], "x double, y double")
    return linear.integrate(fx.cube(spark, d), linear.transmittance(axis, points)).withColumn("v", F.round("v", 6))


_CHAIN = """, blurred AS (""" + _CONV.format(s="") + """), binned AS (
    SELECT l, CAST(i // 3 AS INTEGER) AS a, j, sum(v) AS v FROM blurred, size WHERE i < 3 * (n // 3) GROUP BY ALL) """


def _forward(spark, d, c):
    g = _grid(spark, d)
    binned = linear.box_decimate(linear.circular_blur(c, fx.psf(spark), g, "q"), 3, g.rows // 3)
    return linear.spectral_blur(binned.withColumnRenamed("a", "i"), fx.wpsf(spark), sum_columns=True)


def _adjoint(spark, d, y):
    g = _grid(spark, d)
    columns = y.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(g.columns - 1))))
    slices = linear.spectral_blur_adjoint(columns, fx.wpsf(spark))
    return linear.circular_blur(linear.box_decimate_adjoint(slices.withColumnRenamed("i", "a"), 3), fx.psf(spark), g, transposed=True)


@register("forward_chain", fx.sql("cube", "psf", "wpsf", "size") + _CHAIN + "SELECT lp, a AS i, CAST(sum(v * w) AS BIGINT) AS v FROM binned JOIN wpsf ON wpsf.l = binned.l AND b = j GROUP BY lp, a")
def forward_chain(spark, d):
    return _forward(spark, d, fx.cube(spark, d))


_DETECTOR = ", y AS (SELECT l AS lp, i AS a, q AS y FROM cube, size WHERE l < 32 AND j = 0 AND i < n // 3) "
_BACK = """, back AS (SELECT wpsf.l AS l, a, b AS j, sum(y * w) AS v FROM y JOIN wpsf USING (lp) GROUP BY ALL
), adj AS (SELECT l, CAST((a * 3 + k - di + n) % n AS INTEGER) AS i, CAST((j - dj + 25) % 25 AS INTEGER) AS j, CAST(sum(v * w) AS BIGINT) AS v FROM back, range(0, 3) AS r(k), psf, size GROUP BY ALL) """


def _detector(spark, d):
    n = fx.rows_of(spark, d) // 3
    return fx.cube(spark, d).where(f"l < 32 and j = 0 and i < {n}").select(F.col("l").alias("lp"), "i", F.col("q").alias("v"))


@register("adjoint_chain", fx.sql("cube", "psf", "wpsf", "size") + _DETECTOR + _BACK + "SELECT l, i, j, v FROM adj")
def adjoint_chain(spark, d):
    return _adjoint(spark, d, _detector(spark, d))


@register("dot_identity", fx.sql("cube", "psf", "wpsf", "size") + _CHAIN + _DETECTOR + _BACK + """, fwd AS (SELECT lp, a, sum(v * w) AS v FROM binned JOIN wpsf ON wpsf.l = binned.l AND b = j GROUP BY lp, a)
SELECT CAST((SELECT sum(fwd.v * y.y) FROM fwd JOIN y USING (lp, a)) AS BIGINT) AS y_hx, CAST((SELECT sum(adj.v * cube.q) FROM adj JOIN cube USING (l, i, j)) AS BIGINT) AS hty_x""")
def dot_identity(spark, d):
    c, y = fx.cube(spark, d), _detector(spark, d)
    left = linear.dot(y, _forward(spark, d, c), ["lp", "i"]).withColumnRenamed("dot", "y_hx")
    return left.join(linear.dot(_adjoint(spark, d, y), c.drop("v"), ["l", "i", "j"], "v", "q").withColumnRenamed("dot", "hty_x"), F.lit(True))


# Ordered operators ------------------------------------------------------------

def _diff_sql(axis: str, n: str, transposed: bool) -> str:
    shift = f"({axis} + {n} - 1) % {n}" if transposed else f"({axis} + 1) % {n}"
    return fx.sql("cube", "size") + f", spread AS (SELECT l, i, j, -q AS v FROM cube UNION ALL SELECT l, {'CAST(' + shift + ' AS INTEGER)' if axis == 'i' else 'i'} AS i, {'CAST(' + shift + ' AS INTEGER)' if axis == 'j' else 'j'} AS j, q FROM cube, size) SELECT l, i, j, CAST(sum(v) AS BIGINT) AS v FROM spread GROUP BY l, i, j"


for _axis_name, _n, _label in (("i", "n", "row"), ("j", "25", "col")):
    for _t in (False, True):

        def _diff(spark, d, axis=_axis_name, t=_t):
            return linear.difference(fx.cube(spark, d).drop("v"), axis, fx.rows_of(spark, d) if axis == "i" else fx.COLUMNS, "q", t)

        register(f"diff_{_label}" + "_adj" * _t, _diff_sql(_axis_name, _n, _t))(_diff)


@register("laplacian", fx.sql("cube", "size") + ", st AS (SELECT * FROM (VALUES (0,0,4),(0,1,-1),(0,-1,-1),(1,0,-1),(-1,0,-1)) AS t(di,dj,w)) SELECT l, CAST((i + di + n) % n AS INTEGER) AS i, CAST((j + dj + 25) % 25 AS INTEGER) AS j, CAST(sum(q * w) AS BIGINT) AS v FROM cube, st, size GROUP BY ALL")
def laplacian(spark, d):
    return linear.laplacian(fx.cube(spark, d), _grid(spark, d), "q")


_PACK = ", px AS (SELECT i, j, list(q ORDER BY l) AS s FROM cube GROUP BY i, j) "


@register("median_filter_11", fx.sql("cube") + _PACK + """, padded AS (SELECT i, j, list_concat(list_reverse(s[1:5]), s, list_reverse(s[60:64])) AS p FROM px)
SELECT CAST(k - 1 AS INTEGER) AS l, i, j, list_sort(p[k:k + 10])[6] AS v FROM padded, range(1, 65) AS r(k)""")
def median_filter_11(spark, d):
    return schema.from_spectra(ordered.spectral_median(schema.spectra(fx.cube(spark, d), "q"), 11)).select("l", "i", "j", "v")


@register("box_mean_decimate", fx.sql("cube", "templates") + """, m AS (SELECT m, l, sum(t) OVER (PARTITION BY m ORDER BY l ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0 AS mean FROM templates)
SELECT m, CAST(l // 3 AS INTEGER) AS l, round(mean, 6) AS mean FROM m WHERE l % 3 = 0""")
def box_mean_decimate(spark, d):
    return ordered.box_mean_decimate(fx.templates(fx.cube(spark, d)), "m", "l", "t").withColumn("mean", F.round("mean", 6))


@register("box_mean_2d", fx.sql("cube") + "SELECT l, CAST(ceil(i / 4.0) AS INTEGER) AS i, CAST(ceil(j / 4.0) AS INTEGER) AS j, sum(q) / 16.0 AS mean FROM cube GROUP BY ALL")
def box_mean_2d(spark, d):
    return ordered.box_mean_2d(fx.cube(spark, d), 4, "q")


@register("interp_linear", fx.sql("cube") + _PACK + """, pt AS (SELECT i, j, k, s, k * 63 / 99.0 AS u FROM px, range(0, 100) AS r(k)), lo AS (SELECT *, CAST(least(floor(u), 62) AS INTEGER) AS a FROM pt)
SELECT CAST(k AS INTEGER) AS l, i, j, round(s[a + 1] + (u - a) * (s[a + 2] - s[a + 1]), 6) + 0.0 AS v FROM lo""")
def interp_linear(spark, d):
    px = schema.spectra(fx.cube(spark, d), "q").withColumn("spectrum", F.transform("spectrum", lambda x: x.cast("double")))
    return schema.from_spectra(ordered.resample_linear(px, 100)).select("l", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@register("stride_subsample", fx.sql("cube") + "SELECT CAST(l // 4 AS INTEGER) AS l, i, j, q FROM cube WHERE l % 4 = 0")
def stride_subsample(spark, d):
    return ordered.stride(fx.cube(spark, d), "l", 4).select("l", "i", "j", "q")


@register("upsample", fx.sql("cube", "templates") + "SELECT m, CAST(l * 3 + k AS INTEGER) AS l, t FROM templates, range(0, 3) AS r(k)")
def upsample(spark, d):
    return ordered.upsample(fx.templates(fx.cube(spark, d)), "l", 3).select("m", F.col("l").cast("int").alias("l"), "t")


@register("channel_offsets", "SELECT label, n, CAST(coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def channel_offsets(spark, d):
    sizes = fx.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return ordered.running_offsets(sizes, "label", "n")


@register("random_thinning", fx.sql("cube") + "SELECT l, i, j, q FROM cube WHERE CAST('0x' || substr(md5('1|' || l || '|' || i || '|' || j), 1, 15) AS BIGINT) % 4 = 0")
def random_thinning(spark, d):
    return ordered.thin(fx.cube(spark, d).select("l", "i", "j", "q"), ["l", "i", "j"], 4)


@register("fourier_resample", fx.sql("cube") + """, kernel AS (
    SELECT m, l, (1 + 2 * sum(cos(2 * pi() * k * (m / 32.0 - l / 64.0))) FILTER (k BETWEEN 1 AND 15) + any_value(cos(2 * pi() * 16 * l / 64.0) * (1 - 2 * (m % 2)))) / 32 AS w
    FROM range(0, 32) AS a(m), range(0, 64) AS b(l), range(1, 16) AS c(k) GROUP BY m, l)
SELECT CAST(m AS INTEGER) AS l, i, j, round(sum(v * w), 6) + 0.0 AS v FROM cube JOIN kernel USING (l) GROUP BY m, i, j""")
def fourier_resample(spark, d):
    return schema.from_spectra(dense.fourier_resample(schema.spectra(fx.cube(spark, d)), 32)).select("l", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


# Masks and regions -------------------------------------------------------------

@register("mask_fov", fx.sql("cube", "mask") + "SELECT i, j FROM mask")
def mask_fov(spark, d):
    return selection.mask_of_view(fx.cube(spark, d), 0.35)


@register("apply_mask", fx.sql("cube", "mask") + "SELECT l, i, j, CASE WHEN mask.i IS NULL THEN 0 ELSE q END AS q FROM cube LEFT JOIN mask USING (i, j)")
def apply_mask(spark, d):
    c = fx.cube(spark, d)
    return selection.apply_mask(c.select("l", "i", "j", "q"), selection.mask_of_view(c, 0.35), "q").select("l", "i", "j", F.col("q").cast("long").alias("q"))


@register("dilate8", fx.sql("cube", "mask", "size") + "SELECT DISTINCT CAST(i + a AS INTEGER) AS i, CAST(j + b AS INTEGER) AS j FROM mask, range(-1, 2) AS p(a), range(-1, 2) AS r(b), size WHERE i + a > 0 AND i + a < n - 1 AND j + b > 0 AND j + b < 24")
def dilate8(spark, d):
    return selection.dilate(selection.mask_of_view(fx.cube(spark, d), 0.35), fx.rows_of(spark, d), fx.COLUMNS)


_POLYGON = [(2.2, 3.1), (15.3, 1.4), (17.6, 20.2), (8.5, 12.3), (3.7, 22.8)]


@register("polygon_mean", fx.sql("cube") + ", edge AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True)) + """) AS t(xa, ya, xb, yb)), inside AS (
    SELECT i, j FROM (SELECT DISTINCT i, j FROM cube) p JOIN edge ON (ya > j) <> (yb > j) AND i < (xb - xa) * (j - ya) / (yb - ya) + xa GROUP BY i, j HAVING count(*) % 2 = 1)
SELECT l, round(avg(q), 6) AS mean, count(*) AS n FROM cube JOIN inside USING (i, j) GROUP BY l""")
def polygon_mean(spark, d):
    c = fx.cube(spark, d).where(F.col("i").between(2, 18) & F.col("j").between(1, 23))
    return c.where(selection.in_polygon(F.col("i").cast("double"), F.col("j").cast("double"), _POLYGON)).groupBy("l").agg(F.round(F.avg("q"), 6).alias("mean"), F.count("*").alias("n"))


@register("lambda_window", fx.sql("cube") + "SELECT l, i, j, q FROM cube WHERE l > 10 AND l < 39")
def lambda_window(spark, d):
    c = fx.cube(spark, d).withColumn("x", F.col("l").cast("double"))
    return selection.open_window(c, 10.0, 40.0).select("l", "i", "j", "q")


@register("slit_range_reject", fx.sql("cube") + "SELECT label, l, i, j, q FROM cube WHERE label NOT IN (SELECT label FROM cube WHERE q > 460)")
def slit_range_reject(spark, d):
    c = fx.cube(spark, d).withColumn("x", F.col("q").cast("double"))
    return selection.reject_out_of_range(c, 460.0).select("label", "l", "i", "j", "q")


for _gone in (False, True):

    def _voxels(spark, d, gone=_gone):
        c = fx.cube(spark, d).select("l", "i", "j", "q")
        return selection.keep_voxels(c, c.where("q > 100").select("l", "i", "j"), gone)

    register("voxels_removed" if _gone else "voxels_kept", fx.sql("cube") + f"SELECT l, i, j, q FROM cube WHERE {'NOT ' * _gone}(q > 100)")(_voxels)


@register("clean_values", fx.sql("cube") + "SELECT l, i, j, CASE WHEN v < 0 THEN 0.0 ELSE v END AS v FROM cube")
def clean_values(spark, d):
    return fx.cube(spark, d).select("l", "i", "j", selection.clean(F.col("v")).alias("v"))


@register("trim_empty_planes", fx.sql("cube") + "SELECT l, i, j, q FROM cube WHERE l >= (SELECT min(l) FROM (SELECT l FROM cube GROUP BY l HAVING sum(q) <> 0)) AND l < (SELECT max(l) FROM (SELECT l FROM cube GROUP BY l HAVING sum(q) <> 0))")
def trim_empty_planes(spark, d):
    return selection.trim_empty_planes(fx.cube(spark, d).select("l", "i", "j", "q"), "q")


@register("lambda_channels", fx.sql("cube") + "SELECT CASE WHEN l < 16 THEN 'ch1' WHEN l < 32 THEN 'ch2' WHEN l < 48 THEN 'ch3' ELSE 'ch4' END AS chan, count(*) AS n, CAST(sum(q) AS BIGINT) AS s FROM cube GROUP BY 1")
def lambda_channels(spark, d):
    chan = F.when(F.col("l") < 16, "ch1").when(F.col("l") < 32, "ch2").when(F.col("l") < 48, "ch3").otherwise("ch4")
    return fx.cube(spark, d).groupBy(chan.alias("chan")).agg(F.count("*").alias("n"), F.sum("q").alias("s"))


# Metrics -----------------------------------------------------------------------

_PAIR = ", p AS (SELECT a.l, a.i, a.j, a.q / 1000.0 AS x, b.q / 1000.0 AS y FROM cube a, size JOIN cube b ON b.l = a.l AND b.j = a.j AND b.i = (a.i + 1) % n) "


def _pair(spark, d):
    c, n = fx.cube(spark, d), fx.rows_of(spark, d)
    moved = c.select("l", F.pmod(F.col("i") - 1, F.lit(n)).alias("i"), "j", (F.col("q") / 1000.0).alias("v"))
    return metrics.paired(c.select("l", "i", "j", (F.col("q") / 1000.0).alias("v")), moved, ["l", "i", "j"])


for _name, _f, _sql in (
    ("mse", metrics.mean_square_error, "avg((x - y) * (x - y)) AS mse"),
    ("rel_error", metrics.relative_error, "100 * sum((x - y) * (x - y)) / sum(x * x) AS relative_error"),
    ("psnr", metrics.psnr, "20 * log10((max(x) - min(x)) / sqrt(avg((x - y) * (x - y)))) AS psnr"),
    ("sam", metrics.spectral_angle, "acos(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))) AS sam"),
    ("snr", metrics.signal_to_noise, "10 * log10(sum(x * x) / sum((x - y) * (x - y))) AS snr"),
    ("frobenius", metrics.frobenius, "sqrt(sum((x - y) * (x - y))) AS norm, avg(abs((x - y) / nullif(x, 0))) AS relative"),
    ("extremum_error", metrics.relative_extremum, "(max(x) - max(y)) / max(x) * 100 AS error"),
):
    _out = ", ".join(f"round({c.strip()}, 6) AS {c.strip()}" for c in [part.rsplit(" AS ", 1)[1] for part in _sql.split(", avg(abs")] + (["relative"] if "relative" in _sql and "norm" in _sql else []))

    def _metric(spark, d, f=_f):
        out = f(_pair(spark, d))
        return out.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns])

    register(_name, fx.sql("cube", "size") + _PAIR + f", s AS (SELECT {_sql} FROM p) SELECT " + ("round(norm, 6) AS norm, round(relative, 6) AS relative" if _name == "frobenius" else _out) + " FROM s")(_metric)


@register("ssim", fx.sql("cube", "size") + _PAIR + """, w AS (SELECT l, i + a AS i, j + b AS j, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy FROM p, range(-3, 4) AS u(a), range(-3, 4) AS v(b) GROUP BY ALL HAVING count(*) = 49
), t AS (SELECT mx, my, 49 / 48.0 * (xx - mx * mx) AS vx, 49 / 48.0 * (yy - my * my) AS vy, 49 / 48.0 * (xy - mx * my) AS vxy FROM w)
SELECT round(avg((2 * mx * my + 0.0001) * (2 * vxy + 0.0009) / ((mx * mx + my * my + 0.0001) * (vx + vy + 0.0009))), 6) AS ssim FROM t""")
def ssim(spark, d):
    return metrics.structural_similarity(_pair(spark, d)).select(F.round("ssim", 6).alias("ssim"))


@register("nonzero_mean_spectrum", fx.sql("cube") + "SELECT l, round(coalesce(avg(nullif(q, 0)), 0), 6) AS mean FROM cube GROUP BY l")
def nonzero_mean_spectrum(spark, d):
    return metrics.nonzero_mean(fx.cube(spark, d), "q").withColumn("mean", F.round("mean", 6))


@register("mean_spectrum", fx.sql("cube") + "SELECT l, round(avg(q), 6) AS mean FROM cube GROUP BY l")
def mean_spectrum(spark, d):
    return metrics.mean_spectrum(fx.cube(spark, d), "q").withColumn("mean", F.round("mean", 6))


@register("coverage_mean", fx.sql("cube") + "SELECT i, j, coalesce(round(CAST(sum(q) AS DOUBLE) / nullif(count(*) FILTER (q > 100), 0), 6), 0) AS v FROM cube GROUP BY i, j")
def coverage_mean(spark, d):
    return metrics.coverage_mean(fx.cube(spark, d), 100, "q").withColumn("v", F.round("v", 6))


@register("flux_to_total", fx.sql("cube", "slits") + "SELECT s, l, round(sum(q * w) * tw * 3, 6) AS v FROM cube JOIN slits USING (j) JOIN (SELECT s, sum(w) AS tw FROM slits GROUP BY s) USING (s) GROUP BY s, l, tw")
def flux_to_total(spark, d):
    """Flux of each slit times its weights' sum and the super-resolution factor, 3."""
    slits = linear.slit_weights(spark, 7, 3.5, fx.rows_of(spark, d))
    total = slits.where("i = 0").groupBy("s").agg(F.sum("w").alias("tw"))
    return linear.slice_forward(fx.cube(spark, d), slits, "q").groupBy("s", "l").agg(F.sum("v").alias("v")).join(total, "s").select("s", "l", F.round(F.col("v") * F.col("tw") * 3, 6).alias("v"))


@register("distinct_labels", "SELECT count(DISTINCT label) AS n FROM embeddings")
def distinct_labels(spark, d):
    return fx.table(spark, d, "embeddings").agg(F.countDistinct("label").alias("n"))


@register("label_extents", fx.sql("cube") + "SELECT label, min(i) AS i0, max(i) AS i1, round(avg(i), 6) AS ci, round(avg(j), 6) AS cj FROM cube WHERE l = 0 GROUP BY label")
def label_extents(spark, d):
    return fx.cube(spark, d).where("l = 0").groupBy("label").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.round(F.avg("i"), 6).alias("ci"), F.round(F.avg("j"), 6).alias("cj"))


@register("criterion", fx.sql("cube", "templates", "maps", "size") + """, hx AS (SELECT l, i, j, sum(a * t) AS v FROM maps JOIN templates USING (m) GROUP BY l, i, j)
SELECT round((2.0 * (SELECT sum(CAST(q - hx.v AS DOUBLE) * (q - hx.v)) FROM cube JOIN hx USING (l, i, j)) + 3.0 * (
    (SELECT sum(CAST(p.a - r.a AS DOUBLE) * (p.a - r.a)) FROM maps p, size JOIN maps r ON r.m = p.m AND r.j = p.j AND r.i = (p.i + 1) % n) +
    (SELECT sum(CAST(p.a - r.a AS DOUBLE) * (p.a - r.a)) FROM maps p JOIN maps r ON r.m = p.m AND r.i = p.i AND r.j = (p.j + 1) % 25))) / 2 / 1e15, 4) AS criterion""")
def criterion(spark, d):
    c, g = fx.cube(spark, d), _grid(spark, d)
    x = fx.maps(c)
    y = c.select("l", "i", "j", F.col("q").cast("double").alias("v"))
    hx = linear.mix_maps(x, fx.templates(c)).withColumn("v", F.col("v").cast("double"))
    out = solvers.criterion(y, hx, x.select("m", "i", "j", F.col("a").cast("double").alias("v")), ["l", "i", "j"], 2.0, 3.0, g.rows, g.columns)
    return out.select(F.round(F.col("criterion") / 1e15, 4).alias("criterion"))


# Geometry ----------------------------------------------------------------------

_CUSTOMERS = "pts AS (SELECT c_custkey AS t, CAST(c_custkey % 41 AS DOUBLE) / 10 - 2 AS a, CAST(c_custkey % 29 AS DOUBLE) / 10 - 1.4 AS b FROM customer) "


def _points(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(k.alias("t"), ((k % 41).cast("double") / 10 - 2).alias("a"), ((k % 29).cast("double") / 10 - 1.4).alias("b"))


def _coords(spark, d, f):
    x, y = f(F.col("a"), F.col("b"))
    return _points(spark, d).select("t", (F.round(x, 6) + 0.0).alias("alpha"), (F.round(y, 6) + 0.0).alias("beta"))


@register("rotate_coords", "WITH " + _CUSTOMERS + "SELECT t, round(cos(radians(8.2)) * a + sin(radians(8.2)) * b, 6) + 0.0 AS alpha, round(cos(radians(8.2)) * b - sin(radians(8.2)) * a, 6) + 0.0 AS beta FROM pts")
def rotate_coords(spark, d):
    return _coords(spark, d, lambda a, b: geo.rotated(a, b, 8.2))


@register("local2global", "WITH " + _CUSTOMERS + "SELECT t, round(cos(radians(8.2)) * a - sin(radians(8.2)) * b + 0.3, 6) + 0.0 AS alpha, round(sin(radians(8.2)) * a + cos(radians(8.2)) * b - 0.1, 6) + 0.0 AS beta FROM pts")
def local2global(spark, d):
    return _coords(spark, d, lambda a, b: geo.to_global(a, b, 8.2, (F.lit(0.3), F.lit(-0.1))))


@register("global2local", "WITH " + _CUSTOMERS + "SELECT t, round(cos(radians(8.2)) * (a - 0.3) + sin(radians(8.2)) * (b + 0.1), 6) + 0.0 AS alpha, round(cos(radians(8.2)) * (b + 0.1) - sin(radians(8.2)) * (a - 0.3), 6) + 0.0 AS beta FROM pts")
def global2local(spark, d):
    return _coords(spark, d, lambda a, b: geo.to_local(a, b, 8.2, (F.lit(0.3), F.lit(-0.1))))


@register("pix_snap", "WITH " + _CUSTOMERS + "SELECT t, round_even(a / 0.25, 0) * 0.25 + 0.0 AS alpha, round_even(b / 0.25, 0) * 0.25 + 0.0 AS beta FROM pts")
def pix_snap(spark, d):
    return _points(spark, d).select("t", (geo.snapped(F.col("a"), 0.25) + 0.0).alias("alpha"), (geo.snapped(F.col("b"), 0.25) + 0.0).alias("beta"))


@register("coord_box", "WITH " + _CUSTOMERS + "SELECT min(a) AS a0, max(a) AS a1, (max(a) + min(a)) / 2 AS ac, min(b) AS b0, max(b) AS b1, (max(b) + min(b)) / 2 AS bc FROM pts")
def coord_box(spark, d):
    parts = [f(c).alias(f"{c}{n}") for c in "ab" for f, n in ((F.min, 0), (F.max, 1))]
    return _points(spark, d).agg(*parts, ((F.max("a") + F.min("a")) / 2).alias("ac"), ((F.max("b") + F.min("b")) / 2).alias("bc"))


@register("fov_bbox", "WITH " + _CUSTOMERS + """, c AS (SELECT t, x * (1 + t % 3) / 2 AS x, y * (1 + t % 5) / 2 AS y, a, b FROM pts, (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1)) AS v(x, y))
SELECT t, round(min(cos(radians(30)) * x + sin(radians(30)) * y + a), 6) AS a0, round(max(cos(radians(30)) * x + sin(radians(30)) * y + a), 6) AS a1,
       round(min(cos(radians(30)) * y - sin(radians(30)) * x + b), 6) AS b0, round(max(cos(radians(30)) * y - sin(radians(30)) * x + b), 6) AS b1 FROM c GROUP BY t""")
def fov_bbox(spark, d):
    box = geo.corners((1 + F.col("t") % 3).cast("double"), (1 + F.col("t") % 5).cast("double"), 30.0, (F.col("a"), F.col("b")))
    ends = [F.round(f(F.col("box")[n]), 6).alias(f"{n[0]}{k}") for n in ("alpha", "beta") for f, k in ((F.array_min, 0), (F.array_max, 1))]
    return _points(spark, d).withColumn("box", box).select("t", *ends)


@register("local_grid", "SELECT CAST(k AS INTEGER) AS idx, CAST(-2.75 + 0.25 * k AS DOUBLE) AS x FROM range(0, 23) AS r(k)")
def local_grid(spark, d):
    xs = geo.local_axis(4.0, 0.25, 0.75)
    return spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(xs)], "idx int, x double")


@register("wslice", "WITH " + GRID + " SELECT max(idx) FILTER (x <= 5.1) AS first, min(idx) FILTER (x >= 5.4) AS stop FROM axis")
def wslice(spark, d):
    return geo.wavelength_window(_axis(spark), 5.15, 5.35, 0.05)


@register("slit_window", "WITH " + GRID + " SELECT min(idx) FILTER (x + 0.005 > 5.123) AS first, max(idx) FILTER (x - 0.005 < 5.456) + 1 AS stop FROM axis")
def slit_window(spark, d):
    return geo.index_window(_axis(spark), 5.123, 5.456, 0.005)


@register("slit_table", "SELECT chan, CAST(s AS INTEGER) AS slit, round(w / n, 6) AS width, round((s + 0.5) * (w / n) - w / 2, 6) AS shift FROM (VALUES " + ", ".join(f"('{b}', {v[0]}, {v[5]})" for b, v in geo.BANDS.items()) + ") AS t(chan, n, w), range(0, 21) AS r(s) WHERE s < n")
def slit_table(spark, d):
    return geo.slits(geo.instruments(spark)).select("chan", "slit", F.round("width", 6).alias("width"), F.round("shift", 6).alias("shift"))


@register("nearest_lambda", "WITH " + GRID + ", e AS (SELECT event_id AS t, 5 + value % 1 * 0.63 AS x FROM events WHERE value IS NOT NULL) SELECT t, (SELECT idx FROM axis ORDER BY abs(axis.x - e.x), idx LIMIT 1) AS idx FROM e")
def nearest_lambda(spark, d):
    e = fx.table(spark, d, "events").where("value is not null").select(F.col("event_id").alias("t"), (F.lit(5.0) + F.col("value") % 1 * 0.63).alias("x"))
    return neighbours.nearest_on_axis(e, _axis(spark))


@register("nearest_histogram", "WITH " + GRID + ", e AS (SELECT 5 + value % 1 * 0.63 AS x FROM events WHERE value IS NOT NULL), n AS (SELECT (SELECT idx FROM axis ORDER BY abs(axis.x - e.x), idx LIMIT 1) AS idx FROM e) SELECT axis.idx, count(n.idx) AS n FROM axis LEFT JOIN n ON n.idx = axis.idx GROUP BY axis.idx")
def nearest_histogram(spark, d):
    return _axis(spark).select("idx").join(nearest_lambda(spark, d).groupBy("idx").agg(F.count("*").alias("n")), "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"))


@register("slice_permute", fx.sql("cube") + "SELECT CAST((l + 10) % 64 AS INTEGER) AS l, i, j, q FROM cube")
def slice_permute(spark, d):
    order = spark.range(fx.PLANES).select(F.col("id").cast("int").alias("l"), F.pmod(F.col("id") + 10, F.lit(fx.PLANES)).cast("int").alias("to"))
    return fx.cube(spark, d).join(F.broadcast(order), "l").select(F.col("to").alias("l"), "i", "j", "q")


@register("flip_rotate", fx.sql("cube", "size") + "SELECT l, CAST(24 - j AS INTEGER) AS i, i AS j, q FROM cube")
def flip_rotate(spark, d):
    return fx.cube(spark, d).select("l", (fx.COLUMNS - 1 - F.col("j")).cast("int").alias("i"), F.col("i").alias("j"), "q")


@register("generate_pointings", "WITH " + _CUSTOMERS + "SELECT t, CAST(p AS INTEGER) AS p, a + (p % 2 - 0.5) * 0.25 AS alpha, b + (p // 2 - 0.5) * 0.5 AS beta FROM pts, range(0, 4) AS r(p)")
def generate_pointings(spark, d):
    dithers = spark.createDataFrame([(p, (p % 2 - 0.5) * 0.25, (p // 2 - 0.5) * 0.5) for p in range(4)], "p int, da double, db double")
    return _points(spark, d).join(F.broadcast(dithers), F.lit(True)).select("t", "p", (F.col("a") + F.col("da")).alias("alpha"), (F.col("b") + F.col("db")).alias("beta"))


@register("header_axis", "SELECT o_orderkey AS t, CAST(k AS INTEGER) AS idx, CAST((k + 1 + o_orderkey % 3 - 1) * 0.5 + 4.9 AS DOUBLE) AS x FROM orders, range(0, 7) AS r(k) WHERE k < 1 + o_orderkey % 7")
def header_axis(spark, d):
    k = F.col("o_orderkey")
    xs = geo.axis_from_header(1 + k % 7, 1 + k % 3, F.lit(0.5), F.lit(4.9))
    return fx.table(spark, d, "orders").select(k.alias("t"), F.posexplode(xs).alias("idx", "x")).withColumn("x", F.round("x", 6))


@register("header_join", "SELECT o_orderkey, c_name, regexp_extract(c_name, '([0-9]+)$', 1) AS part FROM orders JOIN customer ON CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) = o_custkey")
def header_join(spark, d):
    named = fx.table(spark, d, "customer").select("c_name", F.regexp_extract("c_name", "([0-9]+)$", 1).alias("part"))
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(named, orders.o_custkey == named.part.cast("long")).select("o_orderkey", "c_name", "part")


@register("sky_linear", fx.sql("cube") + "SELECT DISTINCT i, j, CAST(((j - 9) * 0.9 + (i - 11) * 0.1) * 0.01 + 83.8 AS DOUBLE) AS alpha, CAST(((j - 9) * -0.1 + (i - 11) * 0.9) * 0.02 - 5.4 AS DOUBLE) AS beta FROM cube")
def sky_linear(spark, d):
    header = {"CRPIX1": 10, "CRPIX2": 12, "CDELT1": 0.01, "CDELT2": 0.02, "CRVAL1": 83.8, "CRVAL2": -5.4, "PC1_1": 0.9, "PC1_2": 0.1, "PC2_1": -0.1, "PC2_2": 0.9}
    a, b = geo.linear_sky(F.col("i"), F.col("j"), header)
    return fx.cube(spark, d).where("l = 0").select("i", "j", F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


@register("oversampled_coords", fx.sql("cube", "size") + "SELECT CAST(i * 3 + a AS INTEGER) AS i, CAST(j * 3 + b AS INTEGER) AS j, CAST(i * 0.3 + a * 0.1 AS DOUBLE) AS alpha, CAST(j * 0.3 + b * 0.1 AS DOUBLE) AS beta FROM cube, size, range(0, 3) AS p(a), range(0, 3) AS r(b) WHERE l = 0 AND i > 0 AND j > 0 AND i < n - 1 AND j < 24")
def oversampled_coords(spark, d):
    c = fx.cube(spark, d).where("l = 0").select("i", "j", (F.col("i") * 0.3).alias("alpha"), (F.col("j") * 0.3).alias("beta"))
    return geo.oversampled(c, 3, 0.1).withColumns({"alpha": F.round("alpha", 6), "beta": F.round("beta", 6)})


@register("extend_axis", "SELECT CAST(k AS INTEGER) AS idx, CAST(CASE WHEN k < 10 THEN 5 - (10 - k) * 0.1 WHEN k < 74 THEN 5 + (k - 10) * 0.01 ELSE 5.63 + (k - 73) * 0.1 END AS DOUBLE) AS x FROM range(0, 84) AS r(k)")
def extend_axis(spark, d):
    packed = _axis(spark).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("x"))
    return ordered.extend_axis(packed).select(F.posexplode("x").alias("idx", "x")).withColumn("x", F.round("x", 6))


# Scattered data and labels -------------------------------------------------------

@register("components", fx.sql("cube").replace("WITH", "WITH RECURSIVE", 1) + """, px AS (SELECT i, j, i * 25 + j AS p FROM cube WHERE l = 0 AND q > 50
), e AS MATERIALIZED (SELECT a.p AS a, b.p AS b FROM px a JOIN px b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1
), reach AS (SELECT a AS node, b AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT i, j, CAST(min(other) AS BIGINT) AS label FROM px JOIN reach ON node = p GROUP BY i, j""")
def components(spark, d):
    return neighbours.label_components(fx.cube(spark, d).where("l = 0 and q > 50"), fx.COLUMNS)


@register("sorted_labels", fx.sql("cube") + ", c AS (SELECT label, row_number() OVER (ORDER BY avg(j), label) AS r FROM cube WHERE l = 0 GROUP BY label) SELECT i, j, CAST(r AS INTEGER) AS label FROM cube JOIN c USING (label) WHERE l = 0")
def sorted_labels(spark, d):
    return neighbours.sort_labels(fx.cube(spark, d).where("l = 0").select("i", "j", "label"))


_SCATTER = fx.sql("cube") + ", s AS (SELECT i + j % 3 * 0.2 AS sx, j + i % 4 * 0.15 AS sy, v FROM cube WHERE l = 1), t AS (SELECT i * 25 + j AS t, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y FROM cube WHERE l = 0) "


def _scatter(spark, d):
    c = fx.cube(spark, d)
    samples = c.where("l = 1").select(F.xxhash64("i", "j").alias("id"), (F.col("i") + F.col("j") % 3 * 0.2).alias("sx"), (F.col("j") + F.col("i") % 4 * 0.15).alias("sy"), "v")
    return c.where("l = 0").select((F.col("i") * 25 + F.col("j")).alias("t"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y")), samples


@register("shepard", _SCATTER + "SELECT t, round(coalesce(sum(exp(-2 * d * d) * v) / sum(exp(-2 * d * d)), 0), 6) AS v FROM t LEFT JOIN (SELECT t AS k, v, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) + 1e-6 AS d FROM t, s) n ON k = t AND d <= 2 GROUP BY t")
def shepard(spark, d):
    targets, samples = _scatter(spark, d)
    return neighbours.shepard(targets, samples, cutoff=2.0).withColumn("v", F.round("v", 6))


@register("nearest_fill", fx.sql("cube") + ", g AS (SELECT i, j, CASE WHEN q > -40 THEN q END AS v FROM cube WHERE l = 2) SELECT h.i, h.j, coalesce(h.v, (SELECT f.v FROM g f WHERE f.v IS NOT NULL ORDER BY (f.i - h.i) * (f.i - h.i) + (f.j - h.j) * (f.j - h.j), f.i, f.j LIMIT 1)) AS v FROM g h")
def nearest_fill(spark, d):
    g = fx.cube(spark, d).where("l = 2").select("i", "j", F.when(F.col("q") > -40, F.col("q")).alias("v"))
    return neighbours.nearest_fill(g, 2)


#: Bilinear weights (t, i, j, w) of targets inside the grid; {t} names their relation (t, x, y).
INSIDE = """base AS (SELECT t, x, y, CAST(least(floor(x), n - 2) AS INTEGER) AS i0, CAST(least(floor(y), 23) AS INTEGER) AS j0 FROM {t}, size WHERE x >= 0 AND y >= 0 AND x <= n - 1 AND y <= 24
), weights AS (SELECT t, i0 + a AS i, j0 + b AS j, (CASE WHEN a = 1 THEN x - i0 ELSE 1 - (x - i0) END) * (CASE WHEN b = 1 THEN y - j0 ELSE 1 - (y - j0) END) AS w FROM base, range(0, 2) AS p(a), range(0, 2) AS r(b))"""


@register("line_profile", fx.sql("cube", "size") + ", targets AS (SELECT CAST(k AS INTEGER) AS t, 1 + k * ((n - 3) / 199.0) AS x, 2 + k * (19 / 199.0) AS y FROM range(0, 200) AS r(k), size), " + INSIDE.format(t="targets") + """, g AS (SELECT l, t, sum(v * w) AS v FROM cube JOIN weights USING (i, j) GROUP BY l, t)
SELECT l, t, round(v / nullif(max(v) OVER (PARTITION BY l), 0), 6) + 0.0 AS v FROM g""")
def line_profile(spark, d):
    n = fx.rows_of(spark, d)
    return neighbours.line_profile(fx.cube(spark, d), (1.0, 2.0), (n - 2.0, 21.0), n, fx.COLUMNS, 200).withColumn("v", F.round("v", 6) + 0.0)


@register("rotate_cube", fx.sql("cube", "size") + """, targets AS (SELECT i * 25 + j AS t, cos(radians(-20)) * (i - (n - 1) / 2.0) + sin(radians(-20)) * (j - 12) + (n - 1) / 2.0 AS x, cos(radians(-20)) * (j - 12) - sin(radians(-20)) * (i - (n - 1) / 2.0) + 12 AS y FROM cube, size WHERE l = 0), """ + INSIDE.format(t="targets") + """
SELECT l, CAST(t // 25 AS INTEGER) AS i, CAST(t % 25 AS INTEGER) AS j, round(sum(v * w), 6) + 0.0 AS v FROM cube JOIN weights USING (i, j) GROUP BY l, t""")
def rotate_cube(spark, d):
    return neighbours.rotate_cube(fx.cube(spark, d), -20.0, fx.rows_of(spark, d), fx.COLUMNS).withColumn("v", F.round("v", 6) + 0.0)


# Solvers -----------------------------------------------------------------------

@register("cg_recover", fx.sql("cube", "templates", "size") + ", " + fx.solver_sql([(10, None)], 0.1) + " SELECT m, i, j, round(v, 5) + 0.0 AS v FROM found")
def cg_recover(spark, d):
    """Maps from a cube by ten conjugate-gradient steps."""
    c, g = fx.cube(spark, d), _grid(spark, d)
    t = materialize(fx.templates(c).select("m", "l", (F.col("t") / 1000.0).alias("t")), "templates")
    gram = materialize(linear.template_gram(t), "gram")
    keys = ["m", "i", "j"]
    right = materialize(linear.unmix_cube(c, t).withColumnRenamed("a", "v"), "right")
    whole = fx.pixels(spark, d).count() == g.rows * g.columns
    normal = solvers.quadratic_normal(lambda x: linear.mix_and_unmix(x, gram), lambda y: y, keys, 1.0, 0.1, g.rows, g.columns, whole=whole)
    return solvers.conjugate_gradient(normal, right, keys, 10).withColumn("v", F.round("v", 5) + 0.0)


@register("expsol")
def expsol(spark, d):
    """Maps that a mixed and blurred cube comes from, by one small system a frequency."""
    c, g = fx.cube(spark, d), _grid(spark, d)
    t = {(r.m, r.l): r.t / 1000 for r in fx.templates(c).collect()}
    names = sorted({m for m, _ in t})
    s = np.array([[t[m, k] for k in range(fx.PLANES)] for m in names])
    number = spark.createDataFrame(list(enumerate(names)), "l int, m int")
    share = fx.psf(spark).withColumn("w", F.col("w") / 10)
    kernel = np.zeros((g.rows, g.columns))
    for di, dj, w in share.collect():
        kernel[di % g.rows, dj % g.columns] += w
    back = linear.circular_blur(c.select("l", "i", "j", "v"), share, g, transposed=True)
    right = linear.unmix_cube(back, fx.templates(c).withColumn("t", F.col("t") / 1000.0))
    stacked = schema.planes(right.join(number, "m").select("l", "i", "j", F.col("a").alias("v")))
    return schema.from_planes(dense.closed_form_maps(stacked, s, np.fft.rfft2(kernel), g, 0.1), g)


@register("nmf")
def nmf(spark, d):
    px = schema.spectra(fx.cube(spark, d).withColumn("v", selection.clean(F.col("v"))))
    return solvers.non_negative_factors(px, 4)[0]


@register("pca")
def pca(spark, d):
    parts, _, share = solvers.principal_components(schema.spectra(fx.cube(spark, d)), 4)
    rows = [(k, float(share[k]), float(share[: k + 1].sum()), [float(x) for x in parts[k]]) for k in range(4)]
    return spark.createDataFrame(rows, "k int, share double, cumulative double, component array<double>")


@register("endmembers")
def endmembers(spark, d):
    found = solvers.endmembers(schema.spectra(fx.cube(spark, d)), 4)
    return spark.createDataFrame([(k, r.i, r.j) for k, r in enumerate(found)], "k int, i int, j int")


@register("poly_fit", "WITH s AS (SELECT CAST(l_quantity AS DOUBLE) / 50 AS x, CAST(l_extendedprice AS DOUBLE) / 100000 AS y FROM lineitem) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM s")
def poly_fit(spark, d):
    s = fx.table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 50).alias("x"), (F.col("l_extendedprice").cast("double") / 100000).alias("y"))
    c = solvers.polynomial_fit(s, 1)
    return spark.createDataFrame([(round(float(c[1]), 6), round(float(c[0]), 6))], "slope double, intercept double")


@register("concat_channels", fx.sql("cube") + "SELECT 'a' AS chan, l, i, j, q FROM cube WHERE l < 32 UNION ALL SELECT 'b', CAST(l - 32 AS INTEGER), i, j, q FROM cube WHERE l >= 32")
def concat_channels(spark, d):
    c = fx.cube(spark, d).select("l", "i", "j", "q")
    parts = [c.where("l < 32").select(F.lit("a").alias("chan"), "*"), c.where("l >= 32").select(F.lit("b").alias("chan"), (F.col("l") - 32).cast("int").alias("l"), "i", "j", "q")]
    return parts[0].unionByName(parts[1])


@register("distance_order", "WITH " + _CUSTOMERS + "SELECT t, row_number() OVER (ORDER BY sqrt(a * a + b * b), t) AS r FROM pts")
def distance_order(spark, d):
    distance = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return ordered.ranked(_points(spark, d), [distance, F.col("t")]).select("t", F.col("r").cast("long").alias("r"))

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave import schema
from specweave.functions import geometry as geo
from specweave.operators import dense, linear, spline, triangulation
from specweave.plans import corrections
from specweave.sources import headers


def brute_weights(p, points):
    """Weights of a triangle with an empty circumcircle over p; None outside the hull."""
    for ids in itertools.combinations(range(len(points)), 3):
        a, b, c = points[list(ids)]
        m = np.array([b - a, c - a]).T
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        u = np.linalg.solve(m, p - a)
        w = np.array([1 - u.sum(), *u])
        if w.min() < 0:
            continue
        centre = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        if (np.hypot(*(points - centre).T) >= np.hypot(*(a - centre)) - 1e-9).all():
            return dict(zip(ids, w, strict=True))
    return None


def test_delaunay_weights_equal_brute_force(spark):
    r = np.random.default_rng(3)
    points, at = r.random((24, 2)) * 10, r.random((30, 2)) * 12 - 1
    samples = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id long, sx double, sy double")
    targets = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "t long, x double, y double")
    got = {}
    for w in triangulation.delaunay_weights(targets, samples, 2.0).collect():
        got.setdefault(w.t, {})[w.id] = w.w
    for k, p in enumerate(at):
        want = brute_weights(p, points)
        assert (want is None) == (k not in got)
        if want:
            assert set(want) == set(got[k]) and all(abs(want[i] - got[k][i]) < 1e-9 for i in want)


def test_delaunay_edges(spark):
    square = spark.createDataFrame([(5, 0.0, 0.0), (6, 2.0, 0.0), (7, 0.0, 2.0), (8, 2.0, 2.0), (9, 0.0, 0.0), (10, None, 1.0), (11, float("nan"), 1.0)], "id long, sx double, sy double")
    targets = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 1.0, 0.0), (3, 3.0, 3.0), (4, None, 0.0)], "t long, x double, y double")
    w = triangulation.delaunay_weights(targets, square, 0.5)
    means = {r.t: (r.w, r.x) for r in w.join(square.withColumnRenamed("id", "k"), F.col("id") == F.col("k")).groupBy("t").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("sx")).alias("x")).collect()}
    assert set(means) == {0, 1, 2} and all(abs(s - 1) < 1e-9 for s, _ in means.values())
    assert means[0][1] == 0 and abs(means[1][1] - 1) < 1e-9 and abs(means[2][1] - 1) < 1e-9
    assert [r.id for r in w.where("t = 0").collect()] == [5]
    assert triangulation.delaunay_weights(targets, square.where("false"), 1.0).count() == 0
    assert triangulation.delaunay_weights(targets.where("false"), square, 1.0).count() == 0
    line = spark.createDataFrame([(k, float(k), 0.0) for k in range(4)], "id long, sx double, sy double")
    assert triangulation.delaunay_weights(spark.createDataFrame([(0, 1.5, 0.3)], "t long, x double, y double"), line, 1.0).count() == 0


@pytest.mark.parametrize("outside", ["nearest", "zero"])
@pytest.mark.parametrize("degrees,turned", [(0, lambda x: x), (90, lambda x: np.rot90(x, 1, (1, 2))), (180, lambda x: x[:, ::-1, ::-1])])
def test_cubic_rotation_by_right_angles(spark, degrees, turned, outside):
    g = schema.GridSpec(7, 7, 2)
    x = np.random.default_rng(1).random((2, 7, 7))
    planes = spark.createDataFrame([(k, [float(v) for v in p.ravel()]) for k, p in enumerate(x)], "l int, plane array<double>")
    out = np.array([r.plane for r in spline.rotate_planes(planes, degrees, g, outside).orderBy("l").collect()]).reshape(x.shape)
    inside = np.s_[:, 1:-1, 1:-1]  # a right angle's rounding may put the border outside
    assert np.allclose(out[inside], turned(x)[inside])


def test_cubic_rotation_keeps_smooth_planes(spark):
    g = schema.GridSpec(41, 41, 1)
    i, j = np.mgrid[:41, :41] - 20.0
    planes = spark.createDataFrame([(0, [float(v) for v in np.exp(-(i**2 + 2 * j**2) / 60).ravel()])], "l int, plane array<double>")
    out = np.array(spline.rotate_planes(planes, 30.0, g).first().plane).reshape(41, 41)
    c, s = np.cos(np.pi / 6), np.sin(np.pi / 6)
    want = np.exp(-((c * i + s * j) ** 2 + 2 * (c * j - s * i) ** 2) / 60)
    assert np.abs(out - want)[8:-8, 8:-8].max() < 1e-4


def test_rotation_goes_on_beyond_the_edge(spark):
    g = schema.GridSpec(9, 9, 1)
    flat = spark.createDataFrame([(0, [3.0] * 81)], "l int, plane array<double>")
    assert np.allclose(spline.rotate_planes(flat, 45.0, g).first().plane, 3.0)
    corner = spline.rotate_planes(flat, 45.0, g, "zero").first().plane
    assert corner[0] == 0 and abs(corner[40] - 3) < 1e-9


def test_repair_goes_in_order(spark):
    px = spark.createDataFrame([(0, 0, [5.0, 0.0, 0.0, 4.0, 0.0]), (0, 1, None), (0, 2, [0.0]), (0, 3, [])], "i int, j int, spectrum array<double>")
    out = {r.j: r.spectrum for r in dense.repair_low(px).collect()}
    assert out == {0: [5.0, 2.5, 3.25, 4.0, 0.0], 1: None, 2: [0.0], 3: []}


def test_closed_form_solves_the_normal_equations(spark):
    g = schema.GridSpec(4, 6, 2)
    r = np.random.default_rng(2)
    s, otf = r.random((2, 5)), np.fft.rfft2(r.random((5, 4, 6)))
    x = r.random((2, 4, 6))
    planes = spark.createDataFrame([(k, [float(v) for v in p.ravel()]) for k, p in enumerate(x)], "l int, plane array<double>")
    system = dense.mixing_system(s, otf, g, 0.3)
    right = dense.from_frequencies(dense.apply_by_frequency(dense.to_frequencies(planes, g), system), g)
    back = dense.closed_form_maps(right, s, otf, g, 0.3)
    assert np.allclose(np.array([p.plane for p in back.orderBy("l").collect()]).reshape(x.shape), x)
    blurred = np.fft.irfft2(np.fft.rfft2(np.einsum("ml,mij->lij", s, x)) * otf, s=(4, 6))
    adjoint = np.einsum("ml,lij->mij", s, np.fft.irfft2(np.fft.rfft2(blurred) * otf.conj(), s=(4, 6)))
    rough = sum(2 * x - np.roll(x, 1, a) - np.roll(x, -1, a) for a in (1, 2))
    assert np.allclose(np.array([p.plane for p in right.orderBy("l").collect()]).reshape(x.shape), adjoint + 0.3 * rough)


def test_slits_share_their_edges(spark):
    axes = geo.local_axis(4.0, 0.025, 0.125), geo.local_axis(4.8, 0.025, 0.125)
    slits = geo.fractional_slits(spark, *axes, 4.0, 4.8, 17)
    assert slits.select("s").distinct().count() == 17
    rows = slits.groupBy("s").agg(F.countDistinct("i").alias("n")).select("n").distinct().collect()
    assert len(rows) == 1
    row = slits.where(slits.i == slits.agg(F.min("i")).first()[0])
    assert row.where("w <= 0 or w > 1").count() == 0
    shared = row.groupBy("j").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    assert all(abs(r.w - 1) < 1e-6 for r in shared.where("n > 1").collect())
    assert shared.agg(F.max("n")).first()[0] <= 2


def test_windows(spark):
    plane = spark.createDataFrame([(a, b, 10 * a + b) for a in range(5) for b in range(5)], "i int, j int, v int")
    assert linear.window_offset([0.0, 1.0, 2.0, 3.0], 1.5, 2) == (0, 3)
    part = linear.crop_window(plane, (1, 3), (2, 4))
    assert sorted((r.i, r.j, r.v) for r in part.collect()) == [(0, 0, 12), (0, 1, 13), (1, 0, 22), (1, 1, 23)]
    assert sorted(r.v - 10 * r.i - r.j for r in linear.paste_window(part, (1, 3), (2, 4)).collect()) == [0] * 4


def test_headers(spark):
    raw = spark.createDataFrame([("x_ch1a_01.fits", 1.0, 2.0, 10.0), ("x_ch3a_01.fits", 3.0, 4.0, 20.0)], "name string, alpha double, beta double, angle double")
    done = spark.createDataFrame([("y_ch1a_01.fits",), ("y_ch1a_02.fits",), ("y_ch3b_01.fits",)], "name string")
    assert {r.name: r.alpha for r in headers.copied_targets(raw, done).collect()} == {"y_ch1a_01.fits": 1.0, "y_ch1a_02.fits": None, "y_ch3b_01.fits": None}
    assert [(r.name, r.angle) for r in headers.turned_headers(raw, done).collect()] == [("y_ch3b_01.fits", 27.5)]
    assert headers.with_instrument(spark.createDataFrame([("1a",)], "name string")).first().n_slit == 21
    with pytest.raises(Exception, match="no band"):
        headers.with_instrument(spark.createDataFrame([("9z",)], "name string")).collect()
    cube = np.arange(12.0).reshape(3, 2, 2)
    files = spark.createDataFrame([("/d/b_ch1a_02.npy", [3, 2, 2], [float(v) for v in cube.ravel()]), ("/d/a_ch1a_01.npy", [3, 2, 2], [float("nan")] * 12)], "path string, shape array<int>, data array<double>")
    got = headers.assembled(files).collect()
    assert all(r.y is None for r in got if r.p == 0) and {(r.lp, r.s, r.a): r.y for r in got if r.p == 1} == {k: float(v) for k, v in np.ndenumerate(cube)}


def test_correction_drops_slits_and_fills_near_samples(spark):
    axis = spark.createDataFrame([(k, 5.0 + k) for k in range(3)], "idx int, x double")
    rows = [(s, 5.0 + k, float(a), float(s)) for s in (2, 5) for k in range(3) for a in range(4)]
    samples = spark.createDataFrame(rows + [(0, 5.0, 0.0, 9.0), (7, 99.0, 0.0, 1.0), (5, 5.0, 0.0, float("nan"))], "label int, x double, alpha double, v double")
    out = corrections.corrected_slices(samples, axis, 4, high=8.0).collect()
    assert len(out) == 2 * 3 * 4 and all(abs(r.v - {0: 2.0, 1: 5.0}[r.s]) < 1e-9 for r in out)

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave import schema
from specweave.functions import geometry as geo
from specweave.operators import dense, linear, neighbours, ordered
from specweave.operators.components import connected_components
from specweave.plans import solvers
from specweave.sources import files

GRID = schema.GridSpec(5, 6, 3)


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(0)
    x = r.integers(-9, 9, (3, 5, 6))
    rows = [(int(a), int(b), int(c), float(x[a, b, c])) for a, b, c in np.ndindex(x.shape)]
    return x, spark.createDataFrame(rows, "l int, i int, j int, v double").persist()


def as_array(df, shape=(3, 5, 6)):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.l, r.i, r.j] = r.v
    return out


def test_differences_and_their_adjoints(small):
    x, c = small
    assert (as_array(linear.difference(c, "i", 5)) == np.roll(x, 1, 1) - x).all()
    assert (as_array(linear.difference(c, "j", 6, transposed=True)) == np.roll(x, -1, 2) - x).all()


def test_fft_and_spatial_blur_agree(spark, small):
    x, c = small
    psf = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0), (0, -1, 0.5)], "di int, dj int, w double")
    kernel = np.zeros((5, 6))
    kernel[0, 0], kernel[1, 0], kernel[0, -1] = 2, 1, 0.5
    for t in (False, True):
        spatial = as_array(linear.circular_blur(c, psf, GRID, transposed=t))
        fourier = as_array(schema.from_planes(dense.fft_blur(schema.planes(c), np.fft.rfft2(kernel), GRID, t), GRID))
        assert np.allclose(spatial, fourier)


def test_bilinear_edges(spark):
    target = lambda x, y: spark.createDataFrame([(0, x, y)], "t int, x double, y double")
    w = linear.bilinear_weights(target(4.0, 5.0), 0, 1, 5, 0, 1, 6).where("w <> 0").collect()
    assert [(r.i, r.j, r.w) for r in w] == [(4, 5, 1.0)]
    assert linear.bilinear_weights(target(4.1, 0.0), 0, 1, 5, 0, 1, 6, "zero").count() == 0
    with pytest.raises(Exception, match="outside"):
        linear.bilinear_weights(target(4.1, 0.0), 0, 1, 5, 0, 1, 6).collect()


def test_median_matches_numpy(spark):
    s = [5.0, 1.0, 4.0, 2.0, 9.0, 7.0, 3.0]
    out = ordered.spectral_median(spark.createDataFrame([(0, 0, s)], "i int, j int, spectrum array<double>"), 5).first().spectrum
    p = np.pad(s, 2, mode="symmetric")
    assert out == [float(np.median(p[k : k + 5])) for k in range(7)]


def test_geometry_counts():
    step = 0.025 / 3600
    axes = {w: geo.local_axis(w / 3600, step, 5 * step) for w in (3.2, 4.0, 5.2, 6.6)}
    assert [geo.pixels_across(w / 3600, a) for w, a in axes.items()] == [128, 162, 210, 266] and [len(a) for a in axes.values()] == [139, 171, 219, 275]
    assert geo.columns_across(2.8 / 17, geo.local_axis(2.8, 0.025, 0.125)) == 7
    assert [geo.super_resolution(p, 0.025) for p in (0.196, 0.196, 0.245, 0.273)] == [7, 7, 9, 10]
    assert geo.common_step([1.0, 0.5, 0.25]) == 0.25


def test_detector_samples_are_those_of_the_bands(spark):
    found = {r.chan: r for r in geo.detector_shapes(spark).collect()}
    assert {b: r.samples for b, r in found.items()} == {b: v[7] for b, v in geo.BANDS.items()}


def test_slits_of_an_even_number_of_samples_get_their_rows(spark):
    step = 0.025 / 3600
    axes = [geo.local_axis(w / 3600, step, 5 * step) for w in (4.0, 4.8)]
    plain, repaired = (geo.fractional_slits(spark, *axes, 4.0 / 3600, 4.8 / 3600, 17, factor=f) for f in (None, 7))
    count = lambda w: w.where("s = 0").select("i").distinct().count()
    assert (count(plain), count(repaired)) == (161, 163)


def test_memory_gradient_and_weights_by_map(spark, small):
    x, c = small
    y = c.withColumnRenamed("l", "m")
    same = lambda z: z
    keys = ["m", "i", "j"]
    flat = np.eye(30).reshape(30, 5, 6)
    around = (4 * flat - sum(np.roll(flat, s, a) for s in (1, -1) for a in (1, 2))).reshape(30, 30)
    for joint, matrix in ((False, around), (True, around @ around)):
        normal = solvers.quadratic_normal(same, same, keys, 2.0, {0: 0.5, 1: 0.0, 2: 1.0}, 5, 6, joint)
        want = np.array([np.linalg.solve(2 * np.eye(30) + mu * matrix, x[m].ravel()) for m, mu in enumerate((0.5, 0.0, 1.0))])
        seen = []
        for solve in (solvers.conjugate_gradient, solvers.memory_gradient):
            found = solve(normal, y, keys, 60, tolerance=1e-14, start=0.5, callback=lambda k, z: seen.append(k))
            got = np.zeros((3, 5, 6))
            for r in found.collect():
                got[r.m, r.i, r.j] = r.v
            assert np.allclose(got.reshape(3, -1), want, atol=1e-5)
        assert seen[0] == 0 and len(seen) > 10


def test_conjugate_gradient_solves(spark, small):
    x, c = small
    a = np.array([[2.0, 0.5, 0.1], [0.5, 3.0, 0.2], [0.1, 0.2, 1.5]])
    t = spark.createDataFrame([(m, k, float(a[m, k])) for m in range(3) for k in range(3)], "m int, l int, t double")
    forward = lambda z: linear.mix_maps(z.withColumnRenamed("v", "a"), t)
    adjoint = lambda y: linear.unmix_cube(y, t).withColumnRenamed("a", "v")
    normal, trace = (lambda z: adjoint(forward(z))), []
    found = solvers.conjugate_gradient(normal, adjoint(c), ["m", "i", "j"], 3, trace=trace)
    want = np.linalg.solve(a.T, x.reshape(3, -1))
    got = np.zeros((3, 5, 6))
    for r in found.collect():
        got[r.m, r.i, r.j] = r.v
    assert np.allclose(got.reshape(3, -1), want, atol=1e-6) and trace[-1] < 1e-8


def test_principal_components(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 4)) * [5, 2, 1, 0.5] + 3
    px = spark.createDataFrame([(k, 0, [float(v) for v in row]) for k, row in enumerate(x)], "i int, j int, spectrum array<double>")
    parts, mean, share = solvers.principal_components(px, 2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(share, (s**2 / (s**2).sum())[:2]) and np.allclose(abs(parts), abs(vt[:2]))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(20)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(31)) and all(found[100 + k] == 100 for k in range(20)) and found[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_over_many_tasks(spark, monkeypatch):
    from specweave.operators import components

    monkeypatch.setattr(components, "EDGES", 8)
    r = np.random.default_rng(2)
    order = r.permutation(60)
    edges = [(int(order[k]), int(order[k + 1])) for k in range(59) if k % 15 != 14] + [(500, 501 + k) for k in range(40)]
    found = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    for k in range(4):
        assert {found[int(n)] for n in order[15 * k : 15 * k + 15]} == {int(min(order[15 * k : 15 * k + 15]))}
    assert all(found[500 + k] == 500 for k in range(41))


def test_nearest_on_axis(spark):
    axis = spark.createDataFrame([(3, 1.0), (0, 2.0), (1, 4.0), (2, 4.5)], "idx int, x double")
    values = [(0, -9.0), (1, 1.0), (2, 1.5), (3, 1.49), (4, 2.9), (5, 3.0), (6, 3.1), (7, 4.25), (8, 99.0), (9, None)]
    found = {r.t: r.idx for r in neighbours.nearest_on_axis(spark.createDataFrame(values, "t int, x double"), axis).collect()}
    assert found == {0: 3, 1: 3, 2: 0, 3: 3, 4: 0, 5: 0, 6: 1, 7: 1, 8: 2, 9: None}
    one = neighbours.nearest_on_axis(spark.createDataFrame(values, "t int, x double"), axis.where("idx = 1"))
    assert {r.t: r.idx for r in one.collect()} == {k: 1 if k < 9 else None for k in range(10)}


def test_nearest_sample_far_away(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0), (1, 90.0, 90.0)], "t int, x double, y double")
    s = spark.createDataFrame([(7, 1.0, 0.0), (5, 0.0, 1.0)], "id int, sx double, sy double")
    assert {(r.t, r.id) for r in neighbours.nearest_sample(t, s, 0.5).collect()} == {(0, 5), (1, 5)}
    assert neighbours.nearest_sample(t, s.limit(0), 0.5).count() == 0


def test_ranks_equal_a_window(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("k")).repartition(5)
    got = [(r.k, r.id) for r in ordered.ranked(df, [F.col("k"), F.col("id")]).orderBy("r").collect()]
    assert got == sorted(got) and ordered.ranked(df, [F.col("k"), F.col("id")]).agg(F.max("r")).first()[0] == 500


def test_metrics_of_equal_and_empty_images(spark):
    from specweave.operators import metrics

    same = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "x double, y double")
    zero = spark.createDataFrame([(0.0, 1.0)], "x double, y double")
    assert metrics.signal_to_noise(same).first()[0] == float("inf") and metrics.psnr(same).first()[0] == float("inf")
    assert metrics.relative_error(zero).first()[0] is None and metrics.relative_extremum(zero).first()[0] is None
    assert metrics.signal_to_noise(zero.withColumn("y", F.col("x"))).first()[0] is None
    nan = spark.createDataFrame([(0, float("nan")), (0, 2.0), (1, None)], "l int, v double")
    assert {r.l: r.mean for r in metrics.mean_spectrum(nan).collect()} == {0: 2.0, 1: None}


def test_transfer_functions_of_components():
    r = np.random.default_rng(0)
    psf, share = r.random((3, 4, 5)), r.random((2, 3))
    out = dense.transfer_function(psf, (8, 9), share)
    assert out.shape == (2, 3, 8, 5) and np.allclose(out[1, 2], share[1, 2] * dense.transfer_function(psf[2], (8, 9)))
    assert np.allclose(dense.transfer_function(psf[0], (8, 9))[0, 0], psf[0].sum())


def test_curve_fits(spark):
    x = np.linspace(0, 2, 60)
    for kind, want, start, f in (("exp", [2.0, -1.5, 0.3], [1.0, -1.0, 0.0], lambda a, b, c: a * np.exp(b * x) + c), ("cosine", [1.5, 3.0, 0.4, -0.2], [1.0, 2.8, 0.3, 0.0], lambda a, b, c, d: a * np.cos(b * x + c) + d)):
        df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, f(*want), strict=True)], "x double, y double")
        assert np.allclose(solvers.curve_fit(df, kind, start), want, atol=1e-6)
    cubic = spark.createDataFrame([(float(u), float(1 - 2 * u + 0.5 * u**3)) for u in x], "x double, y double")
    assert np.allclose(solvers.polynomial_fit(cubic, 3), [1, -2, 0, 0.5], atol=1e-6)


def test_factors_and_endmembers(spark):
    r = np.random.default_rng(6)
    h, w = r.random((2, 12)), r.random((40, 2))
    px = spark.createDataFrame([(k, 0, [float(v) for v in row]) for k, row in enumerate(w @ h)], "i int, j int, spectrum array<double>")
    sweep = solvers.factor_errors(px, [1, 2], 8)
    assert sweep[2] < sweep[1]
    _, _, early = solvers.non_negative_factors(px.repartition(3), 2, rounds=5)
    parts, templates, error = solvers.non_negative_factors(px.repartition(3), 2)
    got = np.array([r.a for r in parts.orderBy("i").collect()])
    assert (got >= 0).all() and (templates >= 0).all() and error < 0.9 * early
    assert np.linalg.norm(got @ templates - w @ h) == pytest.approx(error, rel=0.05)
    share = r.dirichlet(np.ones(3), 30)
    share[:3] = np.eye(3)
    corners = r.random((3, 10)) * 5
    mixed = spark.createDataFrame([(k, 0, [float(v) for v in row]) for k, row in enumerate(share @ corners)], "i int, j int, spectrum array<double>")
    assert {x.i for x in solvers.endmembers(mixed, 3)} == {0, 1, 2}


def test_fits_and_npy(spark, tmp_path):
    x = np.arange(24.0).reshape(2, 3, 4)
    x[0, 0, 1] = np.nan
    (tmp_path / "a.fits").write_bytes(files.fits_bytes([({"BAND": "2a", "RA_V1": 83.5}, None), ({"CRPIX3": 1.0}, x)]))
    units = files.read_fits(spark, str(tmp_path / "a.fits")).orderBy("unit").collect()
    assert units[0].header["BAND"] == "2a" and units[0].data is None and list(units[1].shape) == [2, 3, 4]
    long = files.unfolded(files.read_fits(spark, str(tmp_path / "a.fits")).where("unit = 1"))
    assert long.where("v is null").count() == 1 and long.where("l = 1 and i = 2 and j = 3").first().v == 23.0
    assert files.header_target(files.read_fits(spark, str(tmp_path / "a.fits")), 0, "RA_V1", "DEC_V1").first().alpha == 83.5
    (tmp_path / "b.npy").write_bytes(files.npy_bytes(x))
    assert list(files.read_npy(spark, str(tmp_path / "b.npy")).first().shape) == [2, 3, 4]
    assert spark.range(1).select(files.band_length(F.lit("3c"))).first()[0] == "LONG"


def test_nearest_fill_without_any(spark):
    g = spark.createDataFrame([(0, 0, None), (0, 1, None)], "i int, j int, v double")
    assert neighbours.nearest_fill(g, 2).where("v is null").count() == 2

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave import __main__ as command
from specweave.operators import linear, model
from specweave.plans import fusion
from specweave.schema import GridSpec
from specweave.sources import files, headers, simulation
from specweave.streaming import dithers


def test_dithers_targets_slices_and_axes(spark, tmp_path):
    (tmp_path / "d.dat").write_text("# alpha, beta\n0.5, -1.25\n# more\n 2, 3\n")
    assert [tuple(r) for r in files.read_dithers(spark, str(tmp_path / "d.dat")).collect()] == [(0.5, -1.25), (2.0, 3.0)]
    files.save_targets(spark.createDataFrame([("a.fits", 1.0, 2.0, 3)], "name string, alpha double, beta double, x int"), f"{tmp_path}/t")
    assert [tuple(r) for r in files.load_targets(spark, f"{tmp_path}/t").collect()] == [("a.fits", 1.0, 2.0)]
    slices = spark.createDataFrame([("1a", 0, 1.0), ("2b", 1, 2.0)], "chan string, s int, y double")
    files.write_slices(slices, f"{tmp_path}/s")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/s").select("chan", "s", "y").collect())) == [("1a", 0, 1.0), ("2b", 1, 2.0)]
    (tmp_path / "pce_1a.npy").write_bytes(files.npy_bytes(np.array([0.5, 0.25])))
    assert [tuple(r) for r in files.read_axes(spark, f"{tmp_path}/*.npy").orderBy("idx").collect()] == [("pce_1a", 0, 0.5), ("pce_1a", 1, 0.25)]


def test_a_cube_and_its_axes_in_one_file(spark, tmp_path):
    cube, axis = np.arange(8.0).reshape(2, 2, 2), np.array([5.0, 5.5])
    (tmp_path / "c.fits").write_bytes(files.fits_bytes([({}, cube), ({"EXTNAME": "axes"}, {"wavel": axis, "width": axis * 0 + 0.5})]))
    units = files.read_fits(spark, f"{tmp_path}/c.fits").orderBy("unit").collect()
    assert units[0].data == list(range(8)) and units[1].header["TTYPE1"] == "wavel"
    assert list(units[1].shape) == [2, 2] and units[1].data == [5.0, 0.5, 5.5, 0.5]


def test_corrected_instruments(spark):
    good = spark.createDataFrame([(3, "long", 1.5)], "CHANNEL int, BAND string, PA_V3 double")
    r = headers.corrected_instrument(good).first()
    assert (r.chan, r.n_slit, r.alpha_width, r.angle) == ("3c", 16, 5.5, 9.0)
    for bad in ((5, "LONG"), (1, "other"), (None, "LONG"), (1, None)):
        with pytest.raises(Exception, match="no such channel or band"):
            headers.corrected_instrument(spark.createDataFrame([(*bad, 0.0)], "CHANNEL int, BAND string, PA_V3 double")).collect()


def test_scene(spark):
    r = np.random.default_rng(0)
    x, t = r.random((2, 9, 10)), r.random((2, 7))
    maps = spark.createDataFrame([(int(m), int(i), int(j), float(x[m, i, j])) for m, i, j in np.ndindex(x.shape)], "m int, i int, j int, a double")
    tpl = spark.createDataFrame([(int(m), int(l), float(t[m, l])) for m, l in np.ndindex(t.shape)], "m int, l int, t double")
    small, thin = simulation.scene(maps, tpl, 9, 10, 2, 3)
    padded = np.pad(x, ((0, 0), (1, 0), (1, 0)))
    want = (padded[:, :-1, :-1] + padded[:, 1:, :-1] + padded[:, :-1, 1:] + padded[:, 1:, 1:])[:, ::2, ::2] / 4
    got = {(o.m, o.i, o.j): o.a for o in small.collect()}
    assert set(got) == {(m, i, j) for m in range(2) for i in range(3) for j in range(3)}
    assert all(abs(v - want[m, i + 1, j + 1]) < 1e-12 for (m, i, j), v in got.items())
    assert thin.count() == 6 and [round(o.x, 6) for o in simulation.centred_axis(spark, 3, 0.5).collect()] == [-0.5, 0.0, 0.5]


def test_streamed_back_projection_equals_the_batch(spark, tmp_path):
    weights = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "o int, k int, w double")
    for n, y in enumerate((1.0, 5.0)):
        spark.createDataFrame([(0, y), (1, y + 1)], "o int, y double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del n
    query = dithers.running_adjoint(spark, f"{tmp_path}/in", "o int, y double", weights, ["o"], ["k"]).writeStream.outputMode("complete").format("memory").queryName("adj").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.k: r.v for r in spark.table("adj").collect()} == {0: 6.0, 1: 12.0 + 3 * 8.0}


def test_command_line_recovers_maps(spark, tmp_path):
    r = np.random.default_rng(1)
    grid, factor = GridSpec(7, 6, 5), 2
    t = spark.createDataFrame([(m, l, float(v)) for m in range(2) for l, v in enumerate(r.random(5) + m)], "m int, l int, t double")
    psf = spark.createDataFrame([(0, 0, 0.8), (0, 1, 0.1), (1, 0, 0.1)], "di int, dj int, w double")
    points = spark.createDataFrame([((c, p, a, b, 0, 5), a + da, b + db) for c, p, da, db in (("a", 0, 0.25, 0.5), ("a", 1, 0.5, 0.0)) for a in range(6) for b in range(5)], "t struct<chan:string,p:int,a:int,b:int,first:int,stop:int>, x double, y double")
    fields = linear.bilinear_weights(points, 0.0, 1.0, 7, 0.0, 1.0, 6).where("w > 0").select("t.*", "i", "j", "w")
    slits = spark.createDataFrame([("a", s, a, b, 1.0) for a in range(6) for b in range(5) for s in [min(1, b // 3)]], "chan string, s int, a int, b int, w double")
    wpsf = spark.createDataFrame([(l, l, b, 1.0) for l in range(5) for b in range(5)], "lp int, l int, b int, w double")
    truth = spark.createDataFrame([(m, i, j, float(r.random())) for m in range(2) for i in range(7) for j in range(6)], "m int, i int, j int, v double")
    operator = model.spectrograph(t, psf, grid, fields, slits, wpsf, factor, 3)
    tables = {"samples": operator.forward(truth), "templates": t, "psf": psf, "fields": fields, "slits": slits, "wpsf": wpsf}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    misfit = {}
    for method in fusion.METHODS:
        command.main([str(tmp_path), f"{tmp_path}/out", "--factor", "2", "--weight", "0.0001", "--iterations", "12", "--method", method, "--verbose"], spark)
        found = spark.read.parquet(f"{tmp_path}/out/maps.parquet")
        made = operator.forward(found).withColumnRenamed("v", "u").join(tables["samples"], ["chan", "p", "s", "lp", "i"])
        misfit[method] = made.agg(F.sum((F.col("u") - F.col("v")) ** 2) / F.sum(F.col("v") ** 2)).first()[0]
        assert spark.read.parquet(f"{tmp_path}/out/cube.parquet").count() == 5 * 42
    assert max(misfit.values()) < 1e-3
    dots = operator.dot_test(truth, tables["samples"], ["m", "i", "j"], ["chan", "p", "s", "lp", "i"]).first()
    assert abs(dots.y_hx - dots.hty_x) < 1e-4 * abs(dots.y_hx)
    flux = fusion.to_flux(tables["samples"].where("s = 0"), slits, 2)
    assert abs(flux.agg(F.sum("v")).first()[0] - 6 * tables["samples"].where("s = 0").agg(F.sum("v")).first()[0]) < 1e-6

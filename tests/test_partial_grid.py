"""Grids whose last row ends early, and with pixels that are absent."""

import duckdb
import numpy as np
import pytest

from specweave import schema
from specweave.operators import spline
from specweave.plans import cube_queries, instrument_queries, model_queries, registry  # noqa: F401  (they register their queries)
from specweave.sources import files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Seventeen rows: two pixels are absent inside, a block of 11 by 11 that few blurs fill, and the end of the last row."""
    d = str(tmp_path_factory.mktemp("partial"))
    r = np.random.default_rng(4)
    absent = {30, 71} | {25 * i + j for i in range(4, 15) for j in range(8, 19)}
    rows = [(k, [float(v) for v in np.float32(r.normal(0, 0.3, 64))], k % 3) for k in range(408) if k not in absent]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["fft_conv", "hessian_apply", "unmixed_blur", "fits_cube", "npy_cube", "transfer_blur", "cg_recover", "huber_recover"])
def test_partial_grid_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(float).to_numpy().tolist()))
    assert key(got) == key(want) and len(got)


def test_rotation_takes_absent_pixels_as_0(spark, folder):
    x = np.zeros((64, 17, 25))
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        x[:, r.vec_id // 25, r.vec_id % 25] = r.embedding
    whole = spark.createDataFrame([(l, [float(v) for v in x[l].ravel()]) for l in range(64)], "l int, plane array<double>")
    want = {r.l: r.plane for r in spline.rotate_planes(whole, -20.0, schema.GridSpec(17, 25, 64)).collect()}
    got = registry.QUERIES["rotate_cubic"](spark, folder).collect()
    assert len(got) == 64 * 17 * 25 and all(abs(r.v - want[r.l][25 * r.i + r.j]) < 1e-12 for r in got)


@pytest.mark.parametrize("kind", ["fits", "npy"])
def test_files_tell_absent_voxels_from_those_without_a_value(spark, kind):
    kept = [("a", 0, 0, 0, 1.5), ("a", 0, 0, 2, None), ("a", 1, 1, 1, -2.0), ("b", 0, 0, 0, 3.0)]
    cubes = spark.createDataFrame(kept, "path string, l int, i int, j int, v double")
    content = files.packed_cubes(cubes, kind)
    read = files.fits_units(content).where("unit = 1") if kind == "fits" else files.npy_arrays(content)
    assert sorted(map(tuple, files.unfolded(read).collect()), key=lambda r: r[:4]) == kept
    with pytest.raises(Exception, match="two values of one voxel"):
        files.packed_cubes(cubes.union(cubes), kind).collect()

"""Files of a cube stay small however many rows its grid has."""

import duckdb
import pytest

from specweave.plans import model_queries, registry
from specweave.sources import files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Pixels on both sides of the files' borders, and one so far off that the grid between fits no memory."""
    d = str(tmp_path_factory.mktemp("large"))
    rows = [(25 * i + j, [(i % 977) + j / 32 + p / 1024 for p in range(64)], 0) for i in (0, 1, 255, 256, 511, 512, 70000, 2_000_000_000) for j in (0, 7, 24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["npy_cube", "fits_cube"])
def test_cube_of_many_rows_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT l, i, j, v FROM ({registry.ORACLE_SQL[name]}) ORDER BY l, i, j").fetchall()
    got = registry.QUERIES[name](spark, folder)
    assert got.dtypes == [("l", "int"), ("i", "int"), ("j", "int"), ("v", "double")]
    assert sorted(map(tuple, got.collect())) == want and len(want) == 64 * 24


def test_files_are_bounded(spark, folder):
    arrays = files.npy_arrays(files.packed_cubes(model_queries._cubes(spark, folder), "npy"))
    sizes = [r.n for r in arrays.selectExpr("size(data) AS n").collect()]
    assert len(sizes) == 4 * 5 and max(sizes) <= 16 * 256 * 25

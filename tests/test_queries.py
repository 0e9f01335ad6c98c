import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from specweave.plans import registry

SF = "/root/testdata/sf0.001"
FEW = ["lmm_cube2maps", "lmm_maps2cube", "circ_conv_adj", "wblur_t", "bilinear_adj", "dot_identity", "forward_mcmo", "adjoint_mcmo", "dot_mcmo", "plane_adjoint", "degridding", "coverage_mask", "detector_shapes", "fits_cube", "npy_cube", "fits_targets", "assembled_slices", "scene_maps", "cg_recover", "view_of_all", "corrected_instrument", "distance_order", "nearest_lambda", "fourier_resample", "ssim", "fractional_slits", "random_thinning", "median_filter_11", "polygon_mean", "components", "shepard", "nearest_fill", "slit_table", "header_join", "repair_low", "masked_normal", "hessian_apply", "corrected_slices", "copied_targets", "spectral_response"]


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want) and len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Maps and a cube from detector samples, over tables of a folder: the entry of the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.operators import model
from specweave.plans import solvers
from specweave.runtime import materialize
from specweave.schema import GridSpec

#: Tables of a folder, Parquet, with their columns.
TABLES = {
    "samples": "chan string, p int, s int, lp int, i int, v double",
    "templates": "m int, l int, t double",
    "psf": "di int, dj int, w double",
    "fields": "chan string, p int, a int, b int, i int, j int, w double, first int, stop int",
    "slits": "chan string, s int, a int, b int, w double",
    "wpsf": "lp int, l int, b int, w double",
}
METHODS = {"lcg": solvers.conjugate_gradient, "mmmg": solvers.memory_gradient}


def to_flux(samples: DataFrame, slits: DataFrame, factor: int) -> DataFrame:
    """Samples per solid angle as total flux: each times its slit's sum of weights over the columns and the factor."""
    total = slits.where("a = 0").groupBy("chan", "s").agg(F.sum("w").alias("_w"))
    return samples.join(total, ["chan", "s"]).select(*[c for c in samples.columns if c != "v"], (F.col("v") * F.col("_w") * factor).alias("v"))


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(columns).parquet(f"{folder}/{name}.parquet") for name, columns in TABLES.items()}


def fuse(tables: dict[str, DataFrame], factor: int, weight: float | dict[int, float] = 1.0, iterations: int = 5, method: str = "lcg", templates: int | None = None, scale: bool = False, joint: bool = False, start: float = 0.5, callback=None) -> tuple[DataFrame, DataFrame]:
    """(maps, cube) that explain the samples, with differences of the maps weighted by ``weight``.

    ``templates`` takes the first so many only; ``scale`` turns samples per
    solid angle into flux first. ``method`` is ``lcg`` or ``mmmg``.
    """
    t = tables["templates"] if templates is None else tables["templates"].where(F.col("m") < templates)
    ends = tables["fields"].agg(F.max("i"), F.max("j")).first()
    grid = GridSpec(ends[0] + 1, ends[1] + 1, 0)
    along = tables["samples"].agg(F.max("i")).first()[0] + 1
    operator = model.spectrograph(t, tables["psf"], grid, tables["fields"], tables["slits"], tables["wpsf"], factor, along)
    y = to_flux(tables["samples"], tables["slits"], factor) if scale else tables["samples"]
    right = materialize(operator.adjoint(y), "right")
    normal = solvers.quadratic_normal(operator.forward, operator.adjoint, ["m", "i", "j"], 1.0, weight, grid.rows, grid.columns, joint)
    maps = materialize(METHODS[method](normal, right, ["m", "i", "j"], iterations, start=start, callback=callback), "maps")
    return maps, model.mixing(t).forward(maps)

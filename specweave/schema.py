"""Relations of the data model, and the grid that shapes them.

A cube is ``(l, i, j, v)`` rows: wavelength, row, column, value. ``spectra``
and ``planes`` are its array layouts, for dense kernels. A sparse operator
is a relation of weights between an output and an input key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """The extent of a cube, so that wrapping round needs no pass over it."""

    rows: int
    columns: int
    planes: int


def spectra(cube: DataFrame, value: str = "v") -> DataFrame:
    """One row a pixel, with its values in the order of wavelength."""
    packed = F.array_sort(F.collect_list(F.struct("l", F.col(value).alias("v"))))
    return cube.groupBy("i", "j").agg(F.transform(packed, lambda x: x["v"]).alias("spectrum"))


def from_spectra(pixels: DataFrame) -> DataFrame:
    return pixels.select("i", "j", F.posexplode("spectrum").alias("l", "v"))


def planes(cube: DataFrame, value: str = "v", grid: GridSpec | None = None) -> DataFrame:
    """One row a wavelength, with its values row by row.

    Without ``grid`` every pixel has to be there; with it, absent ones are 0.
    """
    if grid is not None:
        return _whole_planes(cube, value, grid)
    packed = F.array_sort(F.collect_list(F.struct("i", "j", F.col(value).alias("v"))))
    return cube.groupBy("l").agg(F.transform(packed, lambda x: x["v"]).alias("plane"))


def _whole_planes(cube: DataFrame, value: str, grid: GridSpec) -> DataFrame:
    at = (F.col("i") * grid.columns + F.col("j")).cast("int")
    packed = cube.groupBy("l").agg(F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("v"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("at"), batch.column("v"), strict=True)
            whole = [np.bincount(k.values.to_numpy(), v.values.to_numpy(zero_copy_only=False), grid.rows * grid.columns) for k, v in rows]
            yield pa.RecordBatch.from_arrays([batch.column("l"), pa.array(whole, pa.list_(pa.float64()))], names=["l", "plane"])

    return packed.select("l", F.col("p.at").alias("at"), F.col("p.v").alias("v")).mapInArrow(run, "l int, plane array<double>")


def from_planes(stacked: DataFrame, grid: GridSpec) -> DataFrame:
    flat = stacked.select("l", F.posexplode("plane").alias("k", "v"))
    return flat.select("l", F.expr(f"k div {grid.columns}").cast("int").alias("i"), (F.col("k") % grid.columns).cast("int").alias("j"), "v")

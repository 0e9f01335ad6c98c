"""Cubic-spline rotation of planes, in Arrow batches of numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from specweave.schema import GridSpec

#: Samples that an edge goes on for; a spline's memory of a value falls to 1e-7 over them.
EDGE = 12


def spline_matrix(n: int) -> np.ndarray:
    """Values at the knots from cubic B-spline coefficients mirrored at both ends."""
    m = np.eye(n) * 4 / 6
    for k in range(n) if n > 1 else ():
        for neighbour in (k - 1, k + 1):
            m[k, neighbour if 0 <= neighbour < n else 2 * k - neighbour] += 1 / 6
    return m if n > 1 else np.eye(1)


def rotate_planes(stacked: DataFrame, degrees: float, grid: GridSpec, outside: str = "nearest") -> DataFrame:
    """Planes (l, plane) turned about their centre by cubic splines.

    Outside a plane its edge goes on (``nearest``), as far as the turn needs,
    or all is 0 (``zero``). A null or NaN value spreads over its plane.
    """
    rows, columns = grid.rows, grid.columns
    a = np.radians(degrees)
    di, dj = np.meshgrid(np.arange(rows) - (rows - 1) / 2, np.arange(columns) - (columns - 1) / 2, indexing="ij")
    pad = EDGE if outside == "nearest" else 0
    tall, wide = rows + 2 * pad, columns + 2 * pad
    x = (np.cos(a) * di + np.sin(a) * dj).ravel() + (tall - 1) / 2
    y = (np.cos(a) * dj - np.sin(a) * di).ravel() + (wide - 1) / 2
    inside = (x >= 0) & (x <= tall - 1) & (y >= 0) & (y <= wide - 1)
    if outside == "nearest":
        x, y, inside = np.clip(x, 0, tall - 1), np.clip(y, 0, wide - 1), np.ones(len(x), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down, across = np.linalg.inv(spline_matrix(tall)), np.linalg.inv(spline_matrix(wide))
        at = np.flatnonzero(inside)
        base = [np.floor(u[at]).astype(int) for u in (x, y)]
        places = [[_mirrored(b + k, n) for k in range(-1, 3)] for b, n in zip(base, (tall, wide), strict=True)]
        parts = [[_cubic(np.abs(u[at] - b - k)) for k in range(-1, 3)] for u, b in zip((x, y), base, strict=True)]
        for batch in batches:
            v = batch.column("plane").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, rows, columns)
            c = down @ np.pad(v, ((0, 0), (pad, pad), (pad, pad)), mode="edge") @ across.T
            out = np.zeros((len(v), rows * columns))
            for i, p in zip(places[0], parts[0], strict=True):
                for j, q in zip(places[1], parts[1], strict=True):
                    out[:, at] += c[:, i, j] * (p * q)
            yield pa.RecordBatch.from_arrays([batch.column("l"), pa.array(list(out), pa.list_(pa.float64()))], names=["l", "plane"])

    return stacked.mapInArrow(run, "l int, plane array<double>")


def _cubic(d: np.ndarray) -> np.ndarray:
    return np.where(d < 1, 2 / 3 - d * d + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0.0))


def _mirrored(k: np.ndarray, n: int) -> np.ndarray:
    k = np.abs(k) % max(2 * n - 2, 1)
    return np.where(k >= n, 2 * n - 2 - k, k)

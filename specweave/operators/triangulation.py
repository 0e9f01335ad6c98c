"""Piecewise-linear interpolation over the Delaunay triangles of scattered samples.

No triangulation is built as a whole. The triangle over a target is a small
linear program: among the convex combinations of samples that give the
target, the one whose squared lengths have the smallest mean. It is solved
over the samples within a radius and accepted if its circumcircle lies inside
that disc, where every sample was seen; other targets try a larger disc.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.operators.neighbours import within_radius
from specweave.runtime import materialize

#: Directions whose support lines rule out targets that lie outside all samples.
DIRECTIONS = 64


def _around(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Triples of samples, one of them the nearest, that may hold the origin."""
    angle = np.arctan2(y, x)
    turns = (angle - angle[0]) % (2 * np.pi)
    turns[0] = 0.0
    order = np.argsort(turns, kind="stable")
    after = int(np.searchsorted(turns[order], np.pi - 1e-12))
    for p, q in ((after - 1, after), (after, after + 1), (after - 2, after)):
        if 0 < p < q < len(order):
            yield np.array([0, order[p], order[q]])


def _weights(corners: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    a, b, c = corners
    parts = np.array([x[b] * y[c] - x[c] * y[b], x[c] * y[a] - x[a] * y[c], x[a] * y[b] - x[b] * y[a]])
    area = parts.sum()
    size = np.hypot(x[corners], y[corners]).max() ** 2
    return None if abs(area) <= 1e-12 * size else parts / area


def delaunay_corners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Samples of the triangle over the origin, their weights, and its reach.

    The reach is the radius of the disc around the origin that covers the
    circumcircle. Samples come nearest first; of samples on one circle the
    triangle found first stays.
    """
    if len(x) and x[0] == 0 and y[0] == 0:
        return np.array([0]), np.ones(1), 0.0
    corners, w = None, None
    for tried in _around(x, y) if len(x) > 2 else ():
        new = _weights(tried, x, y)
        if new is not None and new.min() >= -1e-9:
            corners, w = tried, new
            break
    if w is None:
        return None
    lifted = x * x + y * y
    for _ in range(10 * len(x)):
        plane = np.linalg.solve(np.column_stack([x[corners], y[corners], np.ones(3)]), lifted[corners])
        below = lifted - (plane[0] * x + plane[1] * y + plane[2])
        entering = int(below.argmin())
        centre = plane[:2] / 2
        if below[entering] >= -1e-10 * lifted[corners].max() or entering in corners:
            radius = np.hypot(x[corners[0]] - centre[0], y[corners[0]] - centre[1])
            return corners, np.clip(w, 0.0, 1.0), float(np.hypot(*centre) + radius)
        swaps = []
        for k in range(3):
            tried = corners.copy()
            tried[k] = entering
            new = _weights(tried, x, y)
            if new is not None and new.min() >= -1e-9:
                swaps.append((-new.min(), k, tried, new))
        if not swaps:
            return None
        _, _, corners, w = min(swaps, key=lambda s: s[:2])
    return None


def _solve(last: bool, radius: float):
    kind = pa.schema([("t", pa.int64()), ("found", pa.bool_()), ("id", pa.list_(pa.int64())), ("w", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, near in zip(batch.column("t").to_pylist(), batch.column("near").to_pylist(), strict=True):
                x, y = (np.array([s[c] for s in near], float) for c in ("dx", "dy"))
                best = delaunay_corners(x, y)
                sure = best is not None and (last or best[2] <= radius)
                rows.append({"t": t, "found": sure, "id": [near[k]["id"] for k in best[0]] if sure else None, "w": list(best[1]) if sure else None})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return run


def delaunay_weights(targets: DataFrame, samples: DataFrame, radius: float) -> DataFrame:
    """Weights (t, id, w) of the samples (id, sx, sy) at each target (t, x, y).

    ``radius`` is the first disc searched, a few sample spacings; it doubles
    until the triangle is proven or the disc holds every sample. A target
    outside all samples gets no weights; only those outside the hull by less
    than its 64 support lines show, and those under long thin triangles of
    the rim, look at many samples. Of repeated places the lowest id counts.
    Null or non-finite coordinates take no part.
    """
    finite = lambda df, *names: df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in names))
    one = finite(samples, "sx", "sy").groupBy("sx", "sy").agg(F.min("id").cast("long").alias("id")).withColumn("v", F.lit(0.0))
    turns = [2 * np.pi * k / DIRECTIONS for k in range(DIRECTIONS)]
    along = lambda a, x, y: F.col(x) * float(np.cos(a)) + F.col(y) * float(np.sin(a))
    reach = one.agg(*[F.max(along(a, "sx", "sy")).alias(f"h{k}") for k, a in enumerate(turns)]).first()
    none = targets.sparkSession.createDataFrame([], "t long, id long, w double")
    if reach[0] is None:
        return none
    slack = 1e-9 * max(1.0, *[abs(h) for h in reach])
    held = finite(targets, "x", "y").select(F.col("t").cast("long").alias("t"), "x", "y")
    for a, h in zip(turns, reach, strict=True):
        held = held.where(along(a, "x", "y") <= h + slack)
    span = 2 * max(reach[k] + reach[(k + DIRECTIONS // 2) % DIRECTIONS] for k in range(DIRECTIONS)) + 1e-9
    left, out = materialize(held, "targets"), none
    while not left.isEmpty():
        last = radius >= span
        near = within_radius(left, one, radius).select("t", F.struct("d", "id", (F.col("sx") - F.col("x")).alias("dx"), (F.col("sy") - F.col("y")).alias("dy")).alias("s"))
        packed = near.groupBy("t").agg(F.array_sort(F.collect_list("s")).alias("near"))
        tried = materialize(packed.mapInArrow(_solve(last, radius), "t long, found boolean, id array<long>, w array<double>"), "triangles")
        sure = tried.where("found")
        out = out.union(sure.select("t", F.explode(F.arrays_zip("id", "w")).alias("c")).select("t", "c.id", "c.w"))
        if last:
            break
        left, radius = materialize(left.join(sure.select("t"), "t", "left_anti"), "targets"), 2 * radius
    return out

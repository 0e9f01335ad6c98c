"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.runtime import discard, materialize, ship, tidy

#: Edges that one task contracts at once, and that it gets on average.
EDGES = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that aren't the smallest of their component there, and those that are, one for each."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(p):
        x, y = root[p], root[q]
        apart = x != y
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that join the same nodes, as stars around the smallest node, each partition for itself.

    A task holds ``EDGES`` edges at a time and what they contract to; where
    that is no less than half as many, it is given out and forgotten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held = [], [], 0
        made = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], names=["u", "v"])
        for batch in batches:
            u.append(batch.column("u").to_numpy())
            v.append(batch.column("v").to_numpy())
            held += batch.num_rows
            if held >= EDGES:
                found = stars(np.concatenate(u), np.concatenate(v))
                u, v, held = [found[0]], [found[1]], len(found[0])
                if held > EDGES // 2:
                    yield made(found)
                    u, v, held = [], [], 0
        if held:
            yield made(stars(np.concatenate(u), np.concatenate(v)))

    ship(edges.sparkSession)
    return edges.mapInArrow(tidy(run), "u long, v long")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Return ``(node, component)``: the smallest node reachable from each.

    ``edges`` holds two long columns and is read as undirected; nulls, self
    loops and repeated edges are ignored, and an empty list gives no rows.
    Each task contracts the edges that it has; large-star and small-star
    steps join what the tasks have found, until all edges are stars. A step
    takes the smallest neighbour by a grouped minimum (combined before the
    shuffle) and joins it back, so that a node with very many edges is never
    gathered in one task: its side of the join can be split.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    e, n = materialize(contracted(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges", counted=True)
    while n:
        e, old = materialize(contracted(e.coalesce(-(-n // EDGES))), "edges"), e
        discard(old)
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(e.select("v", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low + high > 1")
        if loose.isEmpty():
            break
        e, n, old = *materialize(_star(_star(e, larger_only=True), larger_only=False), "edges", counted=True), e
        discard(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _star(e: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over edges (u > v): link neighbours to the smallest.

    The large star links each larger neighbour of a node to the smallest
    node around it; the small star does so for the smaller ones and itself.
    """
    if larger_only:
        around = e.union(e.select("v", "u"))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = around.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        out = e.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m").toDF("u", "v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

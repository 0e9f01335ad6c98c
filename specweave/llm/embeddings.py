"""Near-duplicate vectors: spherical k-means cells, compared in blocks.

Equal vectors form a class that is compared once. Each class goes to its
nearest few cells, so that close vectors share one but for rare cases
(measured in the tests), and blocked cosine products compare the classes of
a cell. A pair counts in the lowest cell that both are in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.operators.components import connected_components
from specweave.runtime import materialize, tidy

#: Rows that the cells are fitted on, and at least for each cell; mean vectors to a cell, most cells, and members compared in one task.
FIT_ROWS, FIT_PER_CELL, PER_CELL, MOST_CELLS, BLOCK = 20_000, 8, 200, 8192, 2048


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """``k`` unit centres; a cell that runs empty starts anew at a far vector."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    own, nearest = np.zeros(len(x), np.int64), np.zeros(len(x))
    for _ in range(rounds):
        for lo in range(0, len(x), 1024):
            near = x[lo : lo + 1024] @ centres.T
            own[lo : lo + 1024], nearest[lo : lo + 1024] = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(size < 1e-9)
        sums[lost] = x[np.argsort(nearest)[: len(lost)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def shared_cells(cells: int) -> int:
    """Cells that a vector goes to: at 0.9, over 99 % of pairs then share one."""
    return min(cells, 6 if cells <= 256 else 8 if cells <= 1024 else 10 if cells <= 2048 else 12)


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cid, weight, side, cell = (table.column(c).to_numpy() for c in ("cid", "n", "side", "cell"))
        x = unit(matrix(table.column("embedding")))
        cells = table.column("cells").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        own = len(left) == len(cid)
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            r, c = np.nonzero(x[rows] @ x[right].T >= threshold)
            i, j = rows[r], right[c]
            keep = cid[i] < cid[j] if own else cid[i] != cid[j]
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                common = cells[p][:, :, None] == cells[q][:, None, :]
                here = np.where(common.any(2), cells[p], np.iinfo(np.int32).max).min(1) == cell[0]
                np.add.at(links, p[here], weight[q[here]])
                np.add.at(links, q[here], weight[p[here]])
            while len(i) and ((p := label[i]) != (q := label[j])).any():
                np.minimum.at(label, p, q)
                np.minimum.at(label, q, p)
                while (label != label[label]).any():
                    label = label[label]
        out = np.flatnonzero((links > 0) | (label != np.arange(len(cid))))
        return pa.table({"cid": cid[out], "links": links[out], "other": cid[label[out]]})

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Return ``vec_id, n_links, component_id, kept`` for each row.

    Two vectors of one length link when their cosine, in double precision, is
    at least ``threshold``. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, and so do rows with a null
    id; these have a null component and are kept. Equal vectors link with one
    another. Rows that repeat an id are vectors of their own; their
    component is named by the smallest id in it. Other columns are ignored,
    and an empty table gives no rows.
    """
    v = F.col("embedding")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    signed = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(F.col(column), lambda x: x + F.lit(0).cast("float")).alias("embedding")).withColumn("sound", sound & F.col("vec_id").isNotNull())
    grouped = signed.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    k = max(1, min(classes.count() // PER_CELL, MOST_CELLS))
    sample = classes.select("cid", "embedding").orderBy(F.xxhash64("rep", "embedding"), "cid").limit(max(FIT_ROWS, FIT_PER_CELL * k)).select("embedding").toArrow().column("embedding").combine_chunks()
    lengths = sample.value_lengths().to_numpy(zero_copy_only=False)
    k = max(1, min(k, len(sample) // FIT_PER_CELL))
    centres = {int(d): spherical_k_means(unit(matrix(sample.take(pa.array(np.flatnonzero(lengths == d))))), min(k, int((lengths == d).sum()))) for d in np.unique(lengths)}

    def assign(batches):
        for batch in batches:
            column = batch.column("embedding")
            length = column.value_lengths().to_numpy(zero_copy_only=False)
            found: list = [None] * batch.num_rows
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                if d not in centres:
                    near = np.zeros((len(at), 1), np.int32)
                else:
                    m = shared_cells(len(centres[d]))
                    near = np.argpartition(-(unit(matrix(column.take(pa.array(at)))) @ centres[d].T), m - 1, axis=1)[:, :m].astype(np.int32)
                for a, c in zip(at, near, strict=True):
                    found[a] = c
            yield batch.append_column("cells", pa.array(found, pa.list_(pa.int32())))

    kind = dict(classes.dtypes)["embedding"]
    placed = classes.select("cid", "n", "embedding").mapInArrow(tidy(assign), f"cid long, n long, embedding {kind}, cells array<int>")
    placed = placed.withColumn("d", F.size("embedding")).withColumn("cell", F.explode("cells"))
    placed = materialize(placed, "cells")
    blocks = placed.groupBy("d", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = placed.join(blocks, ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cid", "n", "embedding", "cells", "d", "cell", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    found = materialize(dealt.groupBy("d", "cell", "p", "q").applyInArrow(_compare(threshold), "cid long, links long, other long"), "links")

    component = connected_components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")).where("a <> b").distinct())
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "cid", "left").join(component, classes.cid == component.node, "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    # Vectors find their class by 128 bits of hashes, not by their components.
    keys = [F.xxhash64(F.lit(seed), "embedding").alias(f"h{seed}") for seed in (1, 2)]
    named = named.join(smallest, "component").select(*keys, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), "component_id")
    own = [F.when(F.col("sound"), k).alias(f"h{seed}") for seed, k in zip((1, 2), keys, strict=True)]
    out = signed.select("vec_id", *own).join(named, ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

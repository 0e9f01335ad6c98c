"""Exact top-k inner products, score at a time over an impact-ordered index.

A block of rows is indexed by posting segments: for each component, the rows
whose value has one quantised impact. Segments are processed by descending
impact for a block of queries. What the unprocessed ones can still add to a
row's score is bounded by the length of what is left of the row times that
of the query; a query stops only when these bounds prove that all its
members are among a few rows, which are then scored exactly.

Vectors with components too large for sums in 64 bits are rare; all their
scores are taken in integers of any size, beside the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.runtime import materialize, tidy

#: Rows indexed in one task, queries answered there, and those answered at once.
ROW_BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 2048, 256
#: Quantised impact: absolute value divided by this.
STEP = 32
#: Bytes of a score in the order of large ones: 2 ** 2239 is beyond any sum of products of doubles.
WIDE_BYTES = 280


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(1024 * vectors)


def largest(d: int) -> int:
    """The largest component of which ``d`` products can be summed in 62 bits."""
    return min(isqrt((1 << 62) // d), (1 << 31) - 1)


class ImpactIndex:
    """Posting segments of integer vectors, by impact and component.

    ``levels`` are (impact, segments, entries after it, length of what is
    left of each row after it), by descending impact.
    """

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        impact = np.abs(rows) // STEP
        self.levels: list[tuple[int, list[tuple[int, np.ndarray, np.ndarray]], int, np.ndarray]] = []
        rest = rows.astype(np.float64)
        for level in np.unique(impact)[::-1]:
            segments = []
            r, d = np.nonzero(impact == level)
            order = np.argsort(d, kind="stable")
            r, d = r[order], d[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for at in np.split(np.arange(len(r)), cuts):
                segments.append((int(d[at[0]]), r[at], rows[r[at], d[at[0]]]))
            rest[r, d] = 0
            self.levels.append((int(level), segments, int(np.count_nonzero(impact < level)), np.sqrt((rest**2).sum(1)) * (1 + 1e-9)))

    def top(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The k best rows and scores of each query, ties to the smaller id, and the levels that each left unread.

        ``own`` is a query's own row, which is no candidate, or -1. A query
        tries to stop where scoring its possible members exactly takes fewer
        products than going on.
        """
        n, d = self.rows.shape
        out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        unread = np.zeros(len(queries), np.int64)
        live = np.arange(len(queries))
        sums = np.zeros((n, len(live)), np.int64)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        for at, (_, segments, entries, rest) in enumerate(self.levels):
            for c, rows, values in segments:
                sums[rows] += values[:, None] * queries[live, c]
            last = at + 1 == len(self.levels)
            if not last and entries >= n * d // 2:
                continue
            done = np.zeros(len(live), bool)
            for c, q in enumerate(live):
                open_rows = n - (own[q] >= 0)
                if not open_rows:
                    done[c] = True
                    continue
                # Floating point: a score is off by less than its share of 1e-9 in either bound.
                score = sums[:, c].astype(np.float64)
                slack = rest * length[q] + np.abs(score) * 1e-12
                low, high = score - slack, score + slack
                if own[q] >= 0:
                    low[own[q]] = high[own[q]] = -np.inf
                kth = np.partition(low, n - min(k, open_rows))[n - min(k, open_rows)]
                members = np.flatnonzero(high >= kth)
                if last or len(members) * d <= entries:
                    members = members[members != own[q]]
                    exact = self.rows[members] @ queries[q]
                    best = np.lexsort((ids[members], -exact))[:k]
                    out[q], done[c], unread[q] = (members[best], exact[best]), True, len(self.levels) - at - 1
            if done.any():
                sums, live = np.ascontiguousarray(sums[:, ~done]), live[~done]
            if not len(live):
                break
        return out, unread


def _large(row) -> np.ndarray:
    """floor(1024 x) of the doubles x, as integers of any size."""
    return np.array([floor(Fraction(x) * 1024) for x in np.frombuffer(row, np.float64)], object)


_FOUND = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("large_score", pa.binary())])


def _answer(k: int, with_large: bool):
    def run(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy(zero_copy_only=False)
        ids, uid = table.column("vec_id").to_numpy(), table.column("uid").to_numpy()
        plain = np.array([v is None for v in table.column("large").to_pylist()])
        d = table.column("d")[0].as_py()
        x = np.zeros((len(ids), d), np.int64)
        x[plain] = np.frombuffer(b"".join(v for v in table.column("vector").to_pylist() if v is not None), np.int32).reshape(-1, d)
        rows, queries = np.flatnonzero(~asked & plain), np.flatnonzero(asked & plain)
        found: list[tuple[int, int, int]] = []
        if len(rows) and len(queries):
            place = {u: i for i, u in enumerate(uid[rows].tolist())}
            own = np.array([place.get(u, -1) for u in uid[queries].tolist()])
            index = ImpactIndex(x[rows])
            for lo in range(0, len(queries), AT_ONCE):
                some = slice(lo, lo + AT_ONCE)
                best, _ = index.top(x[queries[some]], own[some], ids[rows], k)
                found += [(q, int(rows[r]), int(s)) for q, (members, scores) in zip(queries[some].tolist(), best, strict=True) for r, s in zip(members, scores, strict=True)]
        if not plain.all():
            wide = {i: _large(table.column("large")[i].as_py()) for i in np.flatnonzero(~plain).tolist()}
            vector = lambda i: wide[i] if i in wide else x[i].astype(object)
            for q in np.flatnonzero(asked).tolist():
                other = np.flatnonzero(~asked) if q in wide else np.flatnonzero(~asked & ~plain)
                found += [(q, int(r), int(vector(q) @ vector(r))) for r in other if uid[r] != uid[q]]
            found.sort(key=lambda f: (f[0], -f[2], ids[f[1]]))
            seen: dict[int, int] = {}
            found = [f for f in found if seen.setdefault(f[0], 0) < k and not seen.update({f[0]: seen[f[0]] + 1})]
        q, r = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
        edge = 1 << (8 * WIDE_BYTES - 1)
        key = [(f[2] + edge).to_bytes(WIDE_BYTES, "big") if with_large else None for f in found]
        score = [max(-(1 << 63), min((1 << 63) - 1, f[2])) for f in found]
        return pa.Table.from_arrays([pa.array(uid[q]), pa.array(ids[q]), pa.array(ids[r]), pa.array(score, pa.int64()), pa.array(key, pa.binary())], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Return ``query_id, rank, vec_id, score``: each query's k highest scores.

    Vectors become integers by floor(1024 x). Queries are the rows whose id
    is divisible by ``every``; their candidates are all rows but their own of
    the same length. Ties go to the smaller id. A vector that is null or
    empty or holds null or non-finite components, or that has a null id,
    takes no part. Rows that repeat an id are rows of their own, each query
    and candidate. A score beyond 64 bits ranks by its true value and is
    returned as the nearest 64-bit integer. Fewer candidates than k give
    fewer rows; other columns are ignored and an empty table gives no rows.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d, packed, large = [], [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                fits = np.abs(x).max() * 1024 < largest(len(x))
                ids.append(i)
                d.append(len(x))
                packed.append(scaled(x).astype(np.int32).tobytes() if fits else None)
                large.append(None if fits else x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d, pa.int32()), pa.array(packed, pa.binary()), pa.array(large, pa.binary())], names=["vec_id", "d", "vector", "large"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    rows = materialize(rows.mapInArrow(tidy(whole), "vec_id long, d int, vector binary, large binary").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asks = F.col("vec_id") % every == 0
    n, n_asked, n_large = rows.agg(F.count("*"), F.count(F.when(asks, 1)), F.count("large")).first()
    asked = rows.where(asks)
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.lit(False).alias("asked"), dealt(row_blocks).alias("b"), every_block(query_blocks).alias("q"))
    right = asked.select("*", F.lit(True).alias("asked"), every_block(row_blocks).alias("b"), dealt(query_blocks).alias("q"))
    found = left.unionByName(right).groupBy("d", "b", "q").applyInArrow(_answer(k, n_large > 0), "query_uid long, query_id long, vec_id long, score long, large_score binary")
    best = Window.partitionBy("query_uid").orderBy(*[F.desc("large_score")] * (n_large > 0), F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

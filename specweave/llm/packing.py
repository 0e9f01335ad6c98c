"""Best-fit packing of documents into fixed windows, under conflicts.

Bins are ordered by what they have left, and each carries a bitmap of its
sources and one of its duplicate clusters. A piece goes to the tightest bin
that can hold it and doesn't conflict; the search runs on to the successor
until it finds one, and else opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.words import WORD
from specweave.runtime import materialize

#: Words that a bin holds, pieces of one source in a bin, and pieces packed in one task.
CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 4, 4096

COLUMNS = "bin_id long, bin_offset long, doc_id long, piece long, first_word long, n_words long, source string, cluster long"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each piece, taken in the order given.

    A source has ``per_source`` bits, of which each of its pieces sets the
    next; all set, or the cluster's bit set, is a conflict.
    """
    source_bit = {s: k * per_source for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: k for k, c in enumerate(dict.fromkeys(clusters))}
    full = (1 << per_source) - 1
    open_bins: list[tuple[int, int]] = []
    in_sources: list[int] = []
    in_clusters: list[int] = []
    left: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        low, bit = source_bit[source], 1 << cluster_bit[cluster]
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not in_clusters[b] & bit and (in_sources[b] >> low) & full != full:
                break
            at += 1
        if at < len(open_bins):
            open_bins.pop(at)
        else:
            b = len(left)
            left.append(capacity)
            in_sources.append(0)
            in_clusters.append(0)
        bins.append(b)
        offsets.append(capacity - left[b])
        left[b] -= size
        in_clusters[b] |= bit
        used = (in_sources[b] >> low) & full
        in_sources[b] |= (used + 1) << low
        if left[b]:
            insort(open_bins, (left[b], b))
    return bins, offsets


def _pack_shard(capacity: int, per_source: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending"), ("piece", "ascending")])
        shard = table.column("shard")[0].as_py()
        bins, offsets = best_fit(table.column("n_words").to_pylist(), table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity, per_source)
        ids = np.array(bins, np.int64) + shard * (1 << 32)
        return table.drop_columns(["shard"]).add_column(0, "bin_id", pa.array(ids)).add_column(1, "bin_offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """Return one row for each piece: its bin, its place there and its words.

    Columns: ``bin_id``, ``bin_offset`` (words before it in the bin),
    ``doc_id``, ``piece``, ``first_word``, ``n_words``, ``source`` and
    ``cluster``. A document of more than ``capacity`` words is cut into
    pieces of that many and a rest; all words are packed once. No bin holds
    two pieces of one duplicate cluster, nor more than ``per_source`` of one
    source. ``cluster`` names a column with cluster ids; without it, texts
    that are equal are a cluster. A document's own pieces are one as well.

    Pieces are dealt to shards of ``shard_rows`` on average by a hash, so
    that a large source or cluster spreads over all of them, and each shard
    is packed on its own, the largest pieces first, at every size of input:
    the search for the tightest bin sees the bins of one shard. Reruns agree. A text without words, null
    or not, has one row with a null ``bin_id``. A null source is a source; a
    row whose cluster is null is a cluster by its text. Null ids and repeated
    rows are packed like others; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_text = F.xxhash64(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col(cluster).cast("long"), by_text).alias("cluster") if cluster else by_text.alias("cluster"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    # Equal rows are interchangeable: they are counted, and dealt out by a number among them.
    alike = materialize(rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("n")), "sizes")
    alike = alike.withColumn("pieces", F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("long"))
    total = alike.agg(F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_rows))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    pieces = alike.withColumn("copy", upto("n")).withColumn("piece", upto("pieces")).withColumn("first_word", F.col("piece") * capacity)
    pieces = pieces.withColumn("n_words", F.least(F.col("size") - F.col("first_word"), F.lit(capacity)).cast("long"))
    kept = ["doc_id", "piece", "first_word", "n_words", "source", "cluster"]
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(shards)).cast("long")
    packed = pieces.where("n_words > 0").select(*kept, shard.alias("shard")).groupBy("shard").applyInArrow(_pack_shard(capacity, per_source), COLUMNS)
    empty = pieces.where("n_words = 0").select(F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"), *kept)
    return packed.unionByName(empty)

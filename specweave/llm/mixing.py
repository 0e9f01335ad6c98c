"""Mixing sources to target weights along a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; that
stream is cut into blocks of equal size. Golden-ratio points, mapped through
the sources' cumulative weights, give each slot of the mix a source, and the
slot of rank k within its source takes the source's block k modulo its
number of blocks. All of it is DataFrame operations.

Running sums go in two levels, over ranges of bounded size and then within
them, so that neither a source with most of the rows nor a table of very
many sources is ever in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.words import WORD
from specweave.operators.ordered import ranked
from specweave.runtime import materialize

#: The golden ratio's fraction in 64 bits (a fixed value), and slots whose points are exact to 1e-10 in one product.
GOLDEN, SPAN = 0x9E3779B97F4A7C15, 1 << 20
#: Words to a block, and the least number of blocks that a source is cut into (if it has as many words).
BLOCK_WORDS, LEAST_BLOCKS = 4096, 256
#: Slots whose ranks one window counts, and rows that one hash range holds on average.
SLOT_RANGE, RANGE_ROWS = 1 << 16, 2000
#: Intervals that the points are looked up by, at least, and sources whose slots one window adds up.
CELLS, SOURCE_RANGE = 4096, 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` (words) and ``h``, the place in the shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), place(text).alias("h"))


def place(text: Column) -> Column:
    return F.xxhash64(F.lit(20240307), F.col("doc_id").cast("long"), text)


def targets(rows: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Each source's weight, size and target, by filling up to a common level.

    Sources come by code point, null last, and the weights repeat. A source
    whose share by weight is above ``most`` times its size stops there, and
    what it leaves is shared anew. The level rises from round to round; each
    takes the sums of the sources that stop below it and of the others, and
    a round that stops no more of them is the last.
    """
    s = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").isNull(), F.col("source")], "source_no")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(cycle, ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))).withColumn("stop", F.col("source_size") * most)
    s = materialize(s.withColumn("stops_at", F.col("stop") / F.col("weight")), "targets")
    level, stopped = -1.0, -1
    while True:
        below = F.col("stops_at") <= F.lit(level)
        got = s.agg(F.sum("source_size"), F.sum(F.when(below, F.col("stop"))), F.sum(F.when(~below, F.col("weight"))), F.count(F.when(below, 1))).first()
        if got[3] == stopped or not got[2]:
            break
        level, stopped = (got[0] * share - (got[1] or 0.0)) / got[2], got[3]
    return s.withColumn("target", F.when(F.col("stops_at") > F.lit(level), F.col("weight") * F.lit(level)).otherwise(F.col("stop"))).select("source", "source_no", "weight", "source_size", "target")


def _cut(sources: DataFrame) -> DataFrame:
    """The blocks of each source, the slots it is due and its interval of weights."""
    size = F.col("source_size")
    n = F.when(size > 0, F.least(size, F.greatest(F.lit(LEAST_BLOCKS).cast("long"), F.ceil(size / BLOCK_WORDS)))).otherwise(F.lit(0).cast("long"))
    s = sources.withColumn("blocks", n)
    s = s.withColumn("base", F.when(size > 0, F.expr("source_size div blocks")).otherwise(F.lit(1).cast("long"))).withColumn("extra", F.when(size > 0, F.expr("source_size % blocks")).otherwise(F.lit(0).cast("long")))
    s = s.withColumn("due", F.when(size > 0, F.round(F.col("target") * F.col("blocks") / size).cast("long")).otherwise(F.lit(0).cast("long"))).withColumn("part", F.expr(f"source_no div {SOURCE_RANGE}"))
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = s.groupBy("part").agg(F.sum("due").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("all_due"))
    own = Window.partitionBy("part").orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("own", F.sum("due").over(own)).join(parts, "part").withColumn("upto", F.col("start") + F.col("own")).drop("part", "own", "start")
    return s.withColumn("lo", F.coalesce(F.try_divide(F.col("upto") - F.col("due"), "all_due"), F.lit(0.0))).withColumn("hi", F.coalesce(F.try_divide("upto", "all_due"), F.lit(0.0)))


def _point(slot: Column) -> Column:
    """The fractional part of (slot + 1/2) times the golden ratio, by spans of slots, so that it keeps its digits."""
    one, span = GOLDEN / 2**64, (GOLDEN * SPAN % 2**64) / 2**64
    x = slot % SPAN * one + F.expr(f"slot div {SPAN}") * span + one / 2
    return x - F.floor(x)


def schedule(sources: DataFrame) -> DataFrame:
    """The mix as ``slot, source_no, rank, block``, in the order of the slots.

    ``sources`` comes from ``_cut``. A few slots more than are due are dealt,
    as a source's share of the points strays from its weight by a few slots;
    ranks that a source is not due are left out.
    """
    due, n = sources.agg(F.coalesce(F.max("all_due"), F.lit(0)), F.count("*")).first()
    cells_ = max(CELLS, 1 << n.bit_length())
    slots = sources.sparkSession.range(0, due + due // 500 + 64 if due else 0).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", _point(F.col("slot"))).withColumn("cell", F.floor(F.col("point") * cells_).cast("int"))
    cells = sources.where("due > 0").select("source_no", "blocks", "due", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells_).cast("int"), F.floor(F.col("hi") * cells_).cast("int"))).alias("cell"))
    dealt = slots.join(cells, "cell").where("point >= lo and point < hi").select("slot", "source_no", "blocks", "due", F.expr(f"slot div {SLOT_RANGE}").alias("part"))
    parts = dealt.groupBy("source_no", "part").agg(F.count("*").alias("n"))
    parts = parts.select("source_no", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source_no", "part").orderBy("slot")) - 1
    ranked = dealt.withColumn("within", within).join(parts, ["source_no", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    return ranked.where("rank < due").select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def _streamed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with ``start``, its first word's place in its source's stream."""
    bits = min(24, max(1, math.ceil(math.log2(max(1, rows.count()) / RANGE_ROWS))))
    placed = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source).withColumn("part", F.shiftright("h", 64 - bits))
    parts = placed.groupBy("source_no", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("source_no", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("source_no", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("within", within).join(parts, ["source_no", "part"]).withColumn("start", F.col("before") + F.col("within"))


def _block_of(at: Column) -> Column:
    wide = F.col("extra") * (F.col("base") + 1)
    return F.when(at < wide, F.floor(at / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((at - wide) / F.col("base")))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Return ``doc_id, size, source_size, target, taken, h`` for each row.

    ``taken`` counts the words that the mix takes of the row, repeats
    counted; it is at most ``most`` times the size, rounded up to passes. A
    source's taken words are within a block or two of its target.

    A null text has no words and nothing is taken of it. A null source is a
    source of its own, after the others; a null id is shuffled by its text.
    Equal rows are interchangeable. An empty table gives no rows; other
    columns are ignored. Reruns on the same rows agree.
    """
    rows = materialize(sized(docs), "sized")
    sources = materialize(_cut(targets(rows, share, most, weights)), "sources")
    uses = schedule(sources).groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    placed = _streamed(rows, sources)
    full = placed.where("size > 0").withColumn("block", F.explode(F.sequence(_block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1))))
    opens = F.col("block") * F.col("base") + F.least("block", "extra")
    closes = (F.col("block") + 1) * F.col("base") + F.least(F.col("block") + 1, F.col("extra"))
    part = F.least(F.col("start") + F.col("size"), closes) - F.greatest(F.col("start"), opens)
    parts = full.withColumn("part_words", part).join(uses, ["source_no", "block"], "left")
    taken = parts.groupBy("source_no", "start").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "h")], F.sum(F.col("part_words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "h"]
    return taken.select(columns).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged.

    A text is whole: it comes once for each pass that takes at least half of
    its words. Rows equal in id and text share evenly what is taken of them.
    """
    took = mix(docs, share, most, weights).groupBy("doc_id", "h").agg(F.floor(F.try_divide(F.sum("taken"), F.sum("size")) + 0.5).cast("int").alias("_copies")).where("_copies > 0")
    took = took.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_copies")
    keyed = docs.withColumn("_at", place(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = keyed.join(took, keyed["doc_id"].cast("long").eqNullSafe(took["_id"]) & (keyed["_at"] == took["_h"]))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns)

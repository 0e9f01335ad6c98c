"""MinHash near-duplicates with odd sketches.

Each text's shingle set is sampled by MinHash. Bands of the samples propose
pairs; an *odd sketch*, the parity bitmap of all samples, estimates high
similarities precisely from the population count of an XOR, and pairs that
it puts far below the threshold go. What is left is confirmed on full sets.

Texts with one shingle set form a class that is compared once. In a band
bucket, members are first compared with the smallest one only, which links a
group of copies by as many pairs as it has members; buckets whose members
aren't all known to be linked by that are compared in blocks, on full sets
and across the components known so far only. No such pair that shares a bucket is left
out, and pairs are not written down: a block gives its confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm import words
from specweave.operators.components import connected_components, contracted
from specweave.runtime import materialize, tidy

SAMPLES, BITS = 256, 1024
BANDS, ROWS = 24, 5
#: Members of a bucket that are compared with one another in one task, and bytes of their sets.
BLOCK, BLOCK_BYTES = 2048, 16 << 20

_RNG = np.random.default_rng(20240229)
_MULTIPLIERS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SALTS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def minhash(sets: list[np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
    """``SAMPLES`` MinHash values of each set (all sets non-empty)."""
    out = np.empty((len(sets), SAMPLES), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    part = np.cumsum(sizes) // chunk
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sets)], strict=True):
        flat = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])
        for k in range(SAMPLES):
            out[lo:hi, k] = np.minimum.reduceat(flat * _MULTIPLIERS[k] + _SHIFTS[k], starts)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, ``BITS`` bits as int64 words per row."""
    bit = (words.mix(samples.astype(np.uint64) + _SALTS) % np.uint64(BITS)).astype(np.int64)
    at = (np.arange(len(samples))[:, None] * BITS + bit).ravel()
    odd = (np.bincount(at, minlength=len(samples) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(samples), BITS), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.zeros((len(samples), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cells = samples[:, : BANDS * ROWS].reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        key = words.mix(key * np.uint64(0xD6E8FEB86659FD93) + cells[:, :, k])
    return key.view(np.int64)


def most_odd_bits(similarity: float, sigmas: float = 5.0) -> int:
    """The XOR count that a pair of this similarity exceeds only ``sigmas`` out.

    A pair that differs in m of the samples toggles 2m bits, of which an
    expected BITS/2 * (1 - exp(-4m/BITS)) stay odd; m is binomial.
    """
    m = SAMPLES * (1 - similarity)
    spread = math.exp(-4 * m / BITS)
    mean = BITS / 2 * (1 - spread)
    deviation = math.hypot(2 * spread * math.sqrt(m * similarity), math.sqrt(BITS / 4 * (1 - spread**2)))
    return math.ceil(mean + sigmas * max(deviation, 1))


def _signatures(width: int, id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, text_column):
            sets = words.shingle_sets(batch.column(text_column), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            samples = minhash([sets[k] for k in full]) if full else np.zeros((0, SAMPLES), np.uint32)
            bands, sketch, digest = [None] * len(sets), [None] * len(sets), np.zeros((len(sets), 2), np.int64)
            for k, b, o in zip(full, band_keys(samples), odd_sketch(samples), strict=True):
                bands[k], sketch[k] = b, o
                digest[k] = np.frombuffer(xxhash.xxh3_128_digest(sets[k].tobytes()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
            )

    return run


def _sets(width: int, bitmap: np.ndarray):
    """The sets of the documents whose id has its bit in a bitmap."""
    bits = np.uint64(len(bitmap) * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
            at = words.mix(ids) % bits
            hit = (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1
            batch = batch.filter(pa.array(hit.astype(bool) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
            for part in words.slices([batch], "text"):
                packed = [s.tobytes() for s in words.shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "shingles"])

    return run


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap with the bit of each id's hash, 16 bits an id but 32 MB at most.

    Each task gives the words of its own bits, which the executors join; it
    only spares work, as a bit that more ids share lets their sets through.
    """
    bits = 1 << min(28, max(16, (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = words.mix(batch.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(bits)
            word, value = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    found = ids.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("value").to_numpy()
    return out


def _confirmed(least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(p: np.ndarray, q: np.ndarray, least: Fraction) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(p) > len(q):
        p, q = q, p
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    common = int((q[at] == p).sum())
    return least.denominator * common >= least.numerator * (len(p) + len(q) - common)


def _across_components(most: int, least: Fraction):
    """Confirmed links of a block between components that it doesn't yet join.

    Close sketches of different components are compared on full sets, in the
    first band only that a pair shares, and not once a link has joined their
    components: what comes out are fewer links than the block has members.
    """

    def run(table: pa.Table) -> pa.Table:
        doc, comp, size, side = (table.column(c).to_numpy() for c in ("doc", "comp", "n_shingles", "side"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(doc), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("shingles").chunks for x in c]
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        band, own = table.column("band")[0].as_py(), len(left) == len(doc)
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out: list[tuple[int, int]] = []
        for lo in range(0, len(left), 64):
            rows = left[lo : lo + 64]
            now = np.fromiter(map(find, comp.tolist()), np.int64, len(comp))
            apart = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int32)
            near_size = np.minimum(size[rows][:, None], size[right][None, :]) * least.denominator >= np.maximum(size[rows][:, None], size[right][None, :]) * least.numerator
            r, c = np.nonzero((apart <= most) & near_size & (now[rows][:, None] != now[right][None, :]))
            order = np.argsort(apart[r, c], kind="stable")
            i, j = rows[r[order]], right[c[order]]
            shared = bands[i] == bands[j]
            first = bands[i, shared.argmax(1)] == band
            keep = first & (i < j) if own else first
            for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                a, b = find(int(comp[x])), find(int(comp[y]))
                if a != b and _alike(sets[x], sets[y], least):
                    root[max(a, b)] = min(a, b)
                    out.append((int(doc[x]), int(doc[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(4, 5), width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return ``doc_id, n_shingles, component_id, kept`` for each row.

    Words are runs of characters other than ASCII white space, compared with
    A-Z lower-cased. Two documents link when the Jaccard similarity of their
    shingle sets is at least ``threshold``; ``component_id`` is the smallest
    id reachable over links and ``kept`` says that it is the row's own.

    Null or empty texts have no shingles and link with nothing. Rows with a
    null id link with nothing, have a null component and are kept. Rows that
    repeat an id count as one document with the links of each. Ties do not
    occur, other columns are ignored, and an empty table gives no rows.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    most = most_odd_bits(float(threshold))
    signed = materialize(docs.mapInArrow(tidy(_signatures(width, "doc_id", "text")), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"), "signatures")
    rows = signed.where("doc_id is not null and n_shingles > 0")
    classes = materialize(rows.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    members = classes.select("doc", F.explode("bands").alias("band"))
    leaders = members.groupBy("band").agg(F.min("doc").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = members.join(leaders, "band").where("a < doc").select("a", F.col("doc").alias("b")).distinct()
    side = lambda k: classes.select(F.col("doc").alias(k), F.col("sketch").alias(f"sketch_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    odd = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near_size = F.least("n_a", "n_b") * threshold.denominator >= F.greatest("n_a", "n_b") * threshold.numerator
    # No distinct here: the join on a group's smallest document could not be split then.
    checked = materialize(pairs.join(side("b"), "b").join(side("a"), "a").where(near_size & (odd <= most)).select("a", "b"), "pairs")
    links = _confirm(checked, docs, threshold, width)

    # A document whose rows differ stands in several classes, which it links.
    repeated = rows.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("doc_id")
    same = rows.join(repeated, "doc_id").join(classes.select("s1", "s2", "doc"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    links = materialize(links.union(same), "links")

    # Documents of one ``comp`` are linked already; some that are linked have different ones and are compared for nothing.
    near = contracted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).groupBy("u").agg(F.min("v").alias("comp"))
    placed = materialize(classes.join(near, classes.doc == near.u, "left").select("doc", "n_shingles", "bands", "sketch", F.coalesce("comp", "doc").alias("comp")), "placed")
    exploded = placed.select("doc", "comp", "n_shingles", F.explode("bands").alias("band"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int")
    mixed = exploded.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), blocks.alias("blocks")).where("x <> y and n > 2").select("band", "blocks")
    held = exploded.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    held = materialize(held.select("doc", "band", "block", "blocks"), "held")
    if not held.isEmpty():
        sets = _full_sets(held.select("doc").distinct(), docs, width)
        dealt = held.select("doc", "band", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("doc", "band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
        dealt = dealt.join(placed.join(sets, placed.doc == sets.doc_id).drop("doc_id"), "doc")
        links = links.union(dealt.groupBy("band", "p", "q").applyInArrow(_across_components(most, threshold), "a long, b long"))
    component = connected_components(links)
    of_class = classes.join(component, classes.doc == component.node, "left").select("s1", "s2", F.coalesce("component", "doc").alias("component"))
    out = signed.join(of_class, ["s1", "s2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _full_sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles``: the sets of some documents, by a column of ids.

    The texts aren't shuffled for that: a bitmap of the ids goes to the scan,
    and the few sets beyond them join with nothing later.
    """
    bitmap = _bitmap(wanted.toDF("doc_id"))
    return materialize(docs.mapInArrow(tidy(_sets(width, bitmap)), "doc_id long, shingles binary").where(F.length("shingles") > 0), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    sets = _full_sets(pairs.select("a").union(pairs.select("b")).distinct(), docs, width)
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(tidy(_confirmed(threshold)), "a long, b long")


def deduplicate(docs: DataFrame, threshold: Fraction = Fraction(4, 5), width: int = 5) -> DataFrame:
    """The rows of ``docs`` but for all but one document of each group.

    The document with the smallest id stays, with each column as it was. Of
    rows that repeat its id, one stays; rows with a null id all stay.
    """
    found = near_duplicates(docs, threshold, width).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return docs.where("doc_id is null").unionByName(named)

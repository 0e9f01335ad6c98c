"""A Katz backoff bigram model: counts, weights and scores over all texts.

Seen bigrams have Good-Turing discounted counts; what the discounts free in
a context goes to the words not seen there, in proportion to their unigram
probability, by a weight that makes each context sum to one exactly.

Tokens are packed into batches of texts. A batch sends each of its distinct
words and bigrams once, with its training count, to the partition that the
hash of the word or bigram names. The partition adds the batches' counts up
and tells each batch the whole count of what it sent: so a frequent word or
bigram costs an entry a batch wherever it stands, and no task needs the model.

A batch cuts what it sends into few parts. Where the corpus needs more
partitions than that, the parts of several batches are merged, and what they
merge to is sent on in the same way, by the next digit of the hash; counts
come back along that path. The number of rows so grows with the corpus, and
not with batches times partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm import words
from specweave.runtime import discard, materialize, tidy, tidy_group

#: Counts up to this are discounted by Good-Turing's ratio.
LARGEST_DISCOUNTED = 5
#: Tokens for each partition of the count tables, bytes of text to a batch, and parts that a batch is cut into at most.
PARTITION_TOKENS, BATCH_BYTES, FAN_OUT = 1_000_000, 5 << 20, 512

_BEGIN, _END = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)

_BATCHES = "batch long, doc_id array<long>, held array<boolean>, counts array<int>, vocabulary binary, tokens binary, n_tokens long"
_SENT = "batch long, kind int, p long, keys binary, counts binary"
_COUNTED = "batch long, kind int, p long, counts binary, first binary, totals array<long>"
_MERGED = "merged long, batch long, kind int, p long, keys binary, counts binary, place binary"


def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _open(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to token ids, the most frequent words first, so that ids press well."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    for k, batch in enumerate(words.gathered(batches, "text", BATCH_BYTES)):
        ragged = words.Ragged(batch.column("text"))
        frequency = np.bincount(ragged.ids, minlength=len(ragged.words))
        order = np.argsort(-frequency, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashed = words.hashes(ragged.words)[order] if len(order) else np.zeros(0, np.uint64)
        doc_id = batch.column("doc_id").to_pylist()
        held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in doc_id]
        row = {"batch": (part << 32) + k, "doc_id": doc_id, "held": held, "counts": ragged.counts.astype(np.int32), "vocabulary": hashed.tobytes(), "tokens": _press(rank[ragged.ids].astype(np.int32)), "n_tokens": len(ragged.ids) + len(doc_id)}
        yield pa.RecordBatch.from_pylist([row], schema=_PACKED)


_PACKED = pa.schema([("batch", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64())])


class _Batch:
    """The tokens of a batch, each text closed by an end, and their bigrams."""

    def __init__(self, row: dict) -> None:
        counts = np.asarray(row["counts"], np.int64)
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        n = len(vocabulary)
        self.names = np.concatenate([vocabulary, [_END, _BEGIN]])
        self.end, self.begin = n, n + 1
        total = int(counts.sum()) + len(counts)
        self.doc = np.repeat(np.arange(len(counts)), counts + 1)
        closes = np.cumsum(counts + 1) - 1
        is_end = np.zeros(total, bool)
        is_end[closes] = True
        self.token = np.full(total, self.end, np.int64)
        self.token[~is_end] = _open(row["tokens"], np.int32)
        self.context = np.concatenate([[self.begin], self.token[:-1]]) if total else self.token
        self.context[np.concatenate([[0], closes[:-1] + 1])[: len(counts)]] = self.begin
        held = np.asarray(row["held"], bool)
        self.trains = ~held[self.doc] if total else np.zeros(0, bool)
        self.texts, self.training_texts = len(counts), int((~held).sum())
        mixed = words.mix(self.names)
        self.pair = words.mix(mixed[self.context] * _PAIR + mixed[self.token])

    def word_counts(self) -> np.ndarray:
        out = np.bincount(self.token[self.trains], minlength=len(self.names))
        out[self.begin] = self.training_texts
        return out


def _shares(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys by part, the parts that there are, and where each begins."""
    p = (words.mix(keys + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    found, at = np.unique(p[order], return_index=True)
    return order, found, np.append(at, len(keys))


def _parts(batch: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part that keys and their counts are cut into."""
    order, found, at = _shares(keys, parts)
    keys, counts = keys[order], counts[order]
    cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch)), pa.array(np.full(len(found), kind, np.int32)), pa.array(found), pa.array([keys[lo:hi].tobytes() for lo, hi in cut], pa.binary()), pa.array([_press(counts[lo:hi]) for lo, hi in cut], pa.binary())], names=["batch", "kind", "p", "keys", "counts"])


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Batch(row)
            pairs = np.unique(b.pair)
            trained, times = np.unique(b.pair[b.trains], return_counts=True)
            pair_counts = np.zeros(len(pairs), np.int64)
            pair_counts[np.searchsorted(pairs, trained)] = times
            yield _parts(row["batch"], 0, b.names, b.word_counts(), parts)
            yield _parts(row["batch"], 1, pairs, pair_counts, parts)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sent(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of all rows end to end, and where each row's begin."""
    keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([_open(c, np.int64) for c in table.column("counts").to_pylist()])
    return np.concatenate(keys), counts, np.cumsum([0, *map(len, keys)])


def _first(place: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Marks the first trained entry at each place."""
    out = np.zeros(len(place), bool)
    at = np.flatnonzero(trained)
    out[at[np.unique(place[at], return_index=True)[1]]] = True
    return out


def _add_up(table: pa.Table) -> pa.Table:
    """Whole counts of a partition's keys, for each batch that sent them.

    ``first`` marks each trained key for one of its batches only. One row
    more has the number of keys with each small count, of keys and of all.
    """
    table = table.sort_by("batch")
    kind, p = table.column("kind")[0].as_py(), table.column("p")[0].as_py()
    keys, counts, size = _sent(table)
    unique, place = np.unique(keys, return_inverse=True)
    whole = np.zeros(len(unique), np.int64)
    np.add.at(whole, place, counts)
    first = _first(place, counts > 0)
    begins = int(whole[np.searchsorted(unique, _BEGIN)]) if kind == 0 and np.isin(_BEGIN, unique) else 0
    totals = [int((whole == r).sum()) for r in range(1, LARGEST_DISCOUNTED + 2)] + [int((whole > 0).sum()) - (begins > 0), int(whole.sum()) - begins]
    back = whole[place]
    n = table.num_rows
    cut = list(zip(size[:-1].tolist(), size[1:].tolist(), strict=True))
    return pa.table({
        "batch": pa.array([*table.column("batch").to_pylist(), None], pa.int64()),
        "kind": pa.array([kind] * (n + 1), pa.int32()),
        "p": pa.array([p] * (n + 1), pa.int64()),
        "counts": pa.array([*(_press(back[lo:hi]) for lo, hi in cut), None], pa.binary()),
        "first": pa.array([*(np.packbits(first[lo:hi]).tobytes() for lo, hi in cut), None], pa.binary()),
        "totals": pa.array([*[None] * n, totals], pa.list_(pa.int64())),
    })


def _merge(groups: int, parts: int):
    """Merge one part of several batches; cut what they merge to by the next digit.

    Gives the rows to send on, under the number ``merged``, and for each row
    that went in the place of its keys among those.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        kind, p, group = (table.column(c)[0].as_py() for c in ("kind", "p", "group"))
        number = (p * groups + group) * 2 + kind
        keys, counts, size = _sent(table)
        unique, place = np.unique(keys, return_inverse=True)
        whole = np.zeros(len(unique), np.int64)
        np.add.at(whole, place, counts)
        on = _parts(number, kind, unique, whole, parts)
        at = np.empty(len(unique), np.int64)
        at[_shares(unique, parts)[0]] = np.arange(len(unique))
        place = (at[place] << 1) + (counts > 0)
        on = pa.table({"merged": on.column("batch"), "batch": pa.nulls(on.num_rows, pa.int64()), "kind": on.column("kind"), "p": on.column("p"), "keys": on.column("keys"), "counts": on.column("counts"), "place": pa.nulls(on.num_rows, pa.binary())})
        n = table.num_rows
        went = pa.table({"merged": pa.array([number] * n, pa.int64()), "batch": table.column("batch"), "kind": pa.array([kind] * n, pa.int32()), "p": pa.array([p] * n, pa.int64()), "keys": pa.nulls(n, pa.binary()), "counts": pa.nulls(n, pa.binary()), "place": pa.array([_press(place[lo:hi]) for lo, hi in zip(size[:-1], size[1:], strict=True)], pa.binary())})
        return pa.concat_tables([on, went])

    return run


def _unmerge(went: pa.Table, back: pa.Table) -> pa.Table:
    """What came back for a merged row, for each row that went into it."""
    went, back = went.sort_by("batch"), back.sort_by("p")
    parts = [_open(c, np.int64) for c in back.column("counts").to_pylist()]
    counts = np.concatenate(parts)
    first = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8))[: len(c)].astype(bool) for f, c in zip(back.column("first").to_pylist(), parts, strict=True)])
    places = [_open(x, np.int64) for x in went.column("place").to_pylist()]
    size = np.cumsum([0, *map(len, places)])
    flat = np.concatenate(places)
    place, trained = flat >> 1, flat & 1 > 0
    first = _first(place, trained) & first[place]
    cut = list(zip(size[:-1].tolist(), size[1:].tolist(), strict=True))
    n = went.num_rows
    return pa.table({"batch": went.column("batch"), "kind": went.column("kind"), "p": went.column("p"), "counts": pa.array([_press(counts[place[lo:hi]]) for lo, hi in cut], pa.binary()), "first": pa.array([np.packbits(first[lo:hi]).tobytes() for lo, hi in cut], pa.binary()), "totals": pa.nulls(n, pa.list_(pa.int64()))})


def _fans(parts: int, most: int) -> list[int]:
    """Numbers of parts, each a multiple of the one before by at most ``most``, the last of them at least ``parts``."""
    steps = 1
    while most**steps < parts:
        steps += 1
    fan = next(f for f in range(1, most + 1) if f**steps >= parts)
    return [fan ** (k + 1) for k in range(steps)]


def _counted(sent: DataFrame, fans: list[int], batches: int) -> DataFrame:
    """Each sent row's whole counts and marks, and the totals of each partition, as ``_COUNTED``.

    ``batches`` bounds the rows of one part and kind, of which as many are
    merged as the next step cuts parts from each.
    """
    if len(fans) == 1:
        return sent.groupBy("kind", "p").applyInArrow(tidy_group(_add_up), _COUNTED)
    groups = max(1, -(-batches * fans[0] // fans[1]))
    grouped = sent.withColumn("group", F.pmod(F.xxhash64("batch"), F.lit(groups)).cast("long"))
    merged = materialize(grouped.groupBy("kind", "p", "group").applyInArrow(tidy_group(_merge(groups, fans[1])), _MERGED), "merged")
    on = merged.where("place is null").select(F.col("merged").alias("batch"), "kind", "p", "keys", "counts")
    back = materialize(_counted(on, fans[1:], groups), "merged_counts")
    went = merged.where("place is not null").select("merged", "batch", "kind", "p", "place")
    each = went.groupBy("merged").cogroup(back.where("batch is not null").select(F.col("batch").alias("merged"), "p", "counts", "first").groupBy("merged"))
    return each.applyInArrow(tidy_group(_unmerge), _COUNTED).unionByName(back.where("totals is not null"))


def smoothed(n: list[int]) -> np.ndarray | None:
    """Counts of counts on the line of log n_r by log r (Simple Good-Turing).

    Each nonzero count is first spread over the zeros around it. None where
    fewer than two are nonzero or the line falls no faster than 1 / r: then
    Good-Turing has no estimate to give.
    """
    r = np.flatnonzero(n) + 1
    if len(r) < 2:
        return None
    before = np.concatenate([[0], r[:-1]])
    after = np.concatenate([r[1:], [2 * r[-1] - before[-1]]])
    slope, level = np.polyfit(np.log(r), np.log(2 * np.array(n, float)[r - 1] / (after - before)), 1)
    return np.exp(level + slope * np.log(np.arange(1, len(n) + 1))) if slope < -1 else None


def _katz(counts: np.ndarray) -> np.ndarray | None:
    """Katz's ratios, or None where they don't rise between 0 and 1."""
    k = LARGEST_DISCOUNTED
    r = np.arange(1, k + 1)
    tail = (k + 1) * counts[k] / counts[0]
    if tail == 1:
        return None
    ratio = ((r + 1) * counts[1 : k + 1] / counts[:k] / r - tail) / (1 - tail)
    return ratio if (ratio > 0).all() and (ratio < 1).all() and (np.diff(ratio * r) > 0).all() else None


def discounts(n: list[int]) -> np.ndarray:
    """The share of its count that an n-gram keeps, for counts 0 to 5.

    ``n[r - 1]`` n-grams have count r. These are Katz's ratios from
    Good-Turing estimates. Groups of copies lift some counts of counts (five
    copies lift the fifth), so that the ratios may not rise or not lie
    between 0 and 1; they are then taken from the smoothed counts, with
    which they always do. Only where those have no line either (see
    ``smoothed``) a constant is subtracted from each count instead.
    """
    ratio = _katz(np.array(n, float)) if all(n) else None
    if ratio is None and (line := smoothed(n)) is not None:
        ratio = _katz(line)
    if ratio is None:
        r = np.arange(1, LARGEST_DISCOUNTED + 1)
        ratio = (r - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5)) / r
    return np.concatenate([[0.0], ratio])


def kept(count: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Discounted counts. Beyond Good-Turing's range each loses what the last in it does, so that every context leaves some mass."""
    low = np.minimum(count, LARGEST_DISCOUNTED)
    return np.where(count > LARGEST_DISCOUNTED, count - LARGEST_DISCOUNTED * (1 - ratio[-1]), low * ratio[low])


def _gathered(back: pa.Table, kind: int, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and marks of a batch's keys, from what came back."""
    order, found, at = _shares(keys, parts)
    counts, first = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    begins = dict(zip(found.tolist(), zip(at[:-1], at[1:], strict=True), strict=True))
    for k, p, c, f in zip(*(back.column(name).to_pylist() for name in ("kind", "p", "counts", "first")), strict=True):
        if k == kind:
            where = order[slice(*begins[p])]
            counts[where] = _open(c, np.int64)
            first[where] = np.unpackbits(np.frombuffer(f, np.uint8))[: len(where)].astype(bool)
    return counts, first


def _evaluate(parts: int, ratio: np.ndarray, n_all: int, n_words: int):
    """Scores but for backoff weights; the contexts' sums and the weights wanted."""

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        b = _Batch(row)
        known, _ = _gathered(back, 0, b.names, parts)
        pairs, one, place = np.unique(b.pair, return_index=True, return_inverse=True)
        seen, first = _gathered(back, 1, pairs, parts)
        p_word = (known + 0.5) / (n_all + 0.5 * (n_words + 1))
        left, right = b.context[one], b.token[one]
        p_seen = np.where(seen > 0, kept(seen, ratio) / np.maximum(known[left], 1), 0)
        with np.errstate(divide="ignore"):
            event = np.where(seen > 0, np.log10(p_seen), np.log10(p_word[right]))
        weighted = (seen == 0) & (known[left] > 0)
        base = np.bincount(b.doc, np.log10(p_word)[b.token], b.texts)
        score = np.bincount(b.doc, event[place], b.texts)
        tokens, hits = np.bincount(b.doc, minlength=b.texts), np.bincount(b.doc, known[b.token] > 0, b.texts).astype(np.int64)
        # Events that wait for a weight, by context and text.
        event_at = np.flatnonzero(weighted[place])
        waits, times = np.unique(b.context[event_at] * np.int64(max(1, b.texts)) + b.doc[event_at], return_counts=True)
        wanted, which = np.unique(waits // max(1, b.texts), return_inverse=True)
        texts = {"doc_id": row["doc_id"], "held": row["held"], "n_tokens": tokens, "n_known": hits, "base": base, "score": score, "waits": _press(np.stack([which, waits % max(1, b.texts), times]).astype(np.int32))}
        # Contexts' sums over the bigrams that this batch answers for.
        own = np.flatnonzero(first)
        mass, lower = np.bincount(left[own], p_seen[own], len(b.names)), np.bincount(left[own], p_word[right[own]], len(b.names))
        gives = np.bincount(left[own], minlength=len(b.names)) > 0
        asked = np.full(len(b.names), -1, np.int32)
        asked[wanted] = np.arange(len(wanted))
        at = np.flatnonzero(gives | (asked >= 0))
        # One row for the texts, then one for each context.
        head = {"context": b.names[at].view(np.int64), "mass": mass[at].astype(np.float64), "lower": lower[at].astype(np.float64), "asked": asked[at]}
        head = {k: pa.concat_arrays([pa.nulls(1, pa.array(v).type), pa.array(v)]) for k, v in head.items()}
        tail = {f.name: pa.concat_arrays([pa.array([texts[f.name]], f.type), pa.nulls(len(at), f.type)]) for f in _TEXTS}
        return pa.table({"batch": pa.array(np.full(1 + len(at), row["batch"]))} | head | tail)

    return run


_TEXTS = pa.schema([("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("waits", pa.binary())])
_PARTIAL = "batch long, context long, mass double, lower double, asked int, doc_id array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, waits binary"


def _finish(texts: pa.Table, weights: pa.Table) -> pa.Table:
    row = texts.to_pylist()[0]
    score = np.array(row["score"], np.float64)
    which, doc, times = _open(row["waits"], np.int32).reshape(3, -1)
    if len(which):
        weight = np.zeros(int(which.max()) + 1)
        weight[weights.column("asked").to_numpy()] = weights.column("weight").to_numpy()
        score += np.bincount(doc, weight[which] * times, len(score))
    return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["n_tokens"], pa.int64()), "n_known": pa.array(row["n_known"], pa.int64()), "base_score": pa.array(row["base"], pa.float64()), "score": pa.array(score)})


def katz_scores(docs: DataFrame, partition_tokens: int = PARTITION_TOKENS, fan_out: int = FAN_OUT) -> DataFrame:
    """Return each row's ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words of the whole text, A-Z lower-cased, and one end.
    ``base_score`` sums log10 of the smoothed unigram probability, ``score``
    the log10 probability under the backoff model, of all tokens and the
    end. A word outside the training texts is one unknown outcome, so that
    each context's probabilities over the V known words and it sum to one.
    Words and bigrams are known by 64-bit hashes.

    A text is held out when crc32 of its id as text, mod 5, is 1; a null id
    is not. A null text is empty and has an end only. Repeated rows train
    and are scored each; other columns are ignored. With no training tokens
    every outcome has probability 1; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed, batches = materialize(rows.mapInArrow(tidy(_pack), _BATCHES), "tokens", counted=True)
    fans = _fans(max(8, -(-(packed.agg(F.sum("n_tokens")).first()[0] or 0) // partition_tokens)), fan_out)
    counted = materialize(_counted(packed.mapInArrow(tidy(_send(fans[0])), _SENT), fans, batches), "counts")
    size = LARGEST_DISCOUNTED + 3
    sums = {r["kind"]: r["t"] for r in counted.where("totals is not null").groupBy("kind").agg(F.array(*[F.sum(F.col("totals")[k]) for k in range(size)]).alias("t")).collect()}
    n_words, n_all = sums.get(0, [0] * size)[-2:]
    ratio = discounts(sums.get(1, [0] * size)[: LARGEST_DISCOUNTED + 1])

    back = counted.where("totals is null").select("batch", "kind", "p", "counts", "first")
    partial = packed.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(tidy_group(_evaluate(fans[0], ratio, n_all, n_words)), _PARTIAL)
    partial = materialize(partial, "partial")
    discard(packed, counted)
    contexts = partial.where("context is not null")
    seen, below = (F.log10(F.greatest(1 - F.sum(c), F.lit(1e-300))) for c in ("mass", "lower"))
    weights = contexts.groupBy("context").agg((seen - below).alias("weight"))
    wanted = contexts.where("asked >= 0").select("batch", "asked", "context").join(weights, "context").select(F.col("batch").alias("to"), "asked", "weight")
    scored = partial.where("context is null").drop("context", "mass", "lower", "asked").groupBy("batch").cogroup(wanted.groupBy("to"))
    scored = scored.applyInArrow(_finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")

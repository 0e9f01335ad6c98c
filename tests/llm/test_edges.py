"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, and plain versions of whole results."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.llm import chat, embeddings, mixing, near_dup, packing, topk, toxicity


def test_tables_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, score int, size string, held_out string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == toxicity.drop_toxic(docs, labels).count() == 0
    assert packing.pack(docs).count() == mixing.mixed(docs).count() == near_dup.deduplicate(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, n_links int, rank int")
    assert embeddings.near_vectors(vectors).count() == topk.top_k(vectors).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, window string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0


def test_very_long_texts(spark):
    r = np.random.default_rng(0)
    long = " ".join(f"w{k}" for k in r.integers(0, 5000, 400_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, long + " end", "a"), (3, "short text", "b")], "doc_id long, text string, source string")
    out = {x.doc_id: x for x in near_dup.near_duplicates(docs).collect()}
    assert (out[2].component_id, out[3].component_id) == (1, 3) and out[1].n_shingles > 390_000
    assert {x.doc_id: x["size"] for x in mixing.mix(docs).collect()} == {1: 400_000, 2: 400_001, 3: 2}
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {x.doc_id: x.n for x in packed} == {1: 400_000, 2: 400_001, 3: 2}


# Exact top-k ------------------------------------------------------------------------

def brute_top(rows, every, k):
    whole = [(n, i, [int(np.floor(1024 * np.float64(x))) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, i, v in whole:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in whole if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_large_components_and_repeated_ids(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.normal(size=6)]) for k in range(60)]
    rows += [(0, [1.0] * 6), (0, [1.0] * 6), (70, [1e6, 0.0, 0.0, 0.0, 0.0, 0.0]), (71, [0.0, -3e38, 0.0, 0.0, 0.0, 0.0]), (100, [2.0**40] * 6), (101, [1e-9, 2.0**41, 1.0, 1.0, 1.0, 1.0]), (102, [0.5, 0.25]), (200, [0.25, 0.5])]
    frame = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(frame, 10, 5).collect())
    assert got == brute_top(rows, 10, 5)


def test_queries_stop_on_proof():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 64))
    x = topk.scaled(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids, q = np.arange(3000), np.arange(0, 3000, 100)
    found, unread = topk.ImpactIndex(x).top(x[q], q, ids, 10)
    assert (unread > 0).all()
    for k, (members, scores) in zip(q, found):
        exact = x @ x[k]
        exact[k] = -(10**15)
        best = np.lexsort((ids, -exact))[:10]
        assert members.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()


def test_long_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(k, [float(x) for x in r.normal(size=3000)]) for k in range(12)]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 3).collect())
    assert got == brute_top(rows, 5, 3)


# Embeddings -------------------------------------------------------------------------

@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_recall_of_many_cells(spark, monkeypatch, cosine):
    """Pairs at a cosine just above the threshold, among 64 cells and more."""
    monkeypatch.setattr(embeddings, "PER_CELL", 40)
    r = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(r.normal(size=(2000, 64)))
    side = r.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    c = cosine + 0.002
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * side])
    frame = spark.createDataFrame([(k, [float(v) for v in row], 1) for k, row in enumerate(x)], "vec_id long, embedding array<double>, component_id int")
    got = {z.vec_id: z for z in embeddings.near_vectors(frame).collect()}
    assert len(x) // 40 >= 64 and embeddings.shared_cells(len(x) // 40) < 64 // 4
    u = unit(x)
    linked = [np.flatnonzero(u @ u[k] >= 0.9) for k in range(len(x))]
    links = sum(len(n) - 1 for n in linked)
    assert sum(z.n_links for z in got.values()) >= 0.9 * links and all(got[k].n_links <= len(n) - 1 for k, n in enumerate(linked))


def test_repeated_vectors(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 1.0]), (9, [-0.0, 1.0])]
    got = sorted((z.vec_id, z.n_links, z.component_id, z.kept) for z in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (3, 1, 3, True), (9, 2, 1, False)]


# Toxicity ---------------------------------------------------------------------------

def test_repeated_rows_and_long_texts_are_scored_alike(spark):
    docs = [(k, ("bad word " if k % 2 else "good day ") * 20) for k in range(400)]
    docs += [(7, "good day"), (7, "good day"), (500, "good day " * 100_000), (501, "good day " * 100_000 + "bad word " * 30)]
    labels = [(k, k % 2) for k in range(400)] + [(None, 1), (3, None)]
    out = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs) and len({round(x.score, 6) for x in out if x.text == "good day"}) == 1
    assert {x.doc_id: x.predicted for x in out if x.doc_id in (500, 501)} == {500: 0, 501: 1}


# Mixing -----------------------------------------------------------------------------

def test_the_schedule_equals_a_plain_one(spark):
    r = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(r.integers(0, 300))), ["a", "a", "a", "b", None][k % 5]) for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame).collect()
    source = {k: s for k, _, s in rows}
    size, target = Counter(), {}
    for x in out:
        size[source[x.doc_id]] += x["size"]
        target[source[x.doc_id]] = x.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    blocks = {s: min(size[s], max(mixing.LEAST_BLOCKS, -(-size[s] // mixing.BLOCK_WORDS))) for s in names}
    due = {s: round(target[s] * blocks[s] / size[s]) for s in names}
    ends = np.cumsum([due[s] for s in names]) / sum(due.values())
    rank, uses = Counter(), defaultdict(Counter)
    for slot in range(sum(due.values()) * 501 // 500 + 64):
        point = (2 * slot + 1) * mixing.GOLDEN % 2**65 / 2**65
        s = names[min(len(names) - 1, int(np.searchsorted(ends, point, side="right")))]
        if rank[s] < due[s]:
            uses[s][rank[s] % blocks[s]] += 1
        rank[s] += 1
    want = {}
    for s in names:
        mine = sorted((x for x in out if source[x.doc_id] == s), key=lambda x: (x.h, x.doc_id, x["size"]))
        base, extra = divmod(size[s], blocks[s])
        of_word = [b for b in range(blocks[s]) for _ in range(base + (b < extra))]
        at = 0
        for x in mine:
            want[x.doc_id] = sum(uses[s][b] for b in of_word[at : at + x["size"]])
            at += x["size"]
    assert {x.doc_id: x.taken for x in out} == want


# Packing ----------------------------------------------------------------------------

def test_pack_equals_plain_best_fit_and_reruns_agree(spark):
    r = np.random.default_rng(4)
    rows = [(None if k % 9 == 0 else k % 70, " ".join(["w"] * int(r.integers(0, 90))) + f" {k % 40}", ["a", "b", None][k % 3]) for k in range(300)] + [(None, "same text", "a")] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(frame, 64, 2, 10_000)
    items = sorted((x for x in got.collect() if x.bin_id is not None), key=lambda x: (x.bin_id, x.bin_offset))
    again = sorted(map(tuple, packing.pack(frame.repartition(7), 64, 2, 10_000).collect()), key=str)
    assert again == sorted(map(tuple, got.collect()), key=str)
    bins = defaultdict(list)
    for x in items:
        bins[x.bin_id].append(x)
    assert all(sum(x.n_words for x in b) <= 64 and len({x.cluster for x in b}) == len(b) and max(Counter(x.source for x in b).values()) <= 2 for b in bins.values())
    # The same number of bins as the plain rule on the same order of pieces, nulls last.
    order = sorted(items, key=lambda x: (-x.n_words, x.doc_id is None, x.doc_id or 0, x.cluster, x.source is None, x.source or "", x.piece))
    open_bins: list[list] = []
    for x in order:
        able = [b for b in open_bins if 0 < b[0] and b[0] >= x.n_words and x.cluster not in b[1] and b[2][x.source] < 2]
        best = min(able, key=lambda b: (b[0], b[3])) if able else [64, set(), Counter(), len(open_bins)]
        if not able:
            open_bins.append(best)
        best[0] -= x.n_words
        best[1].add(x.cluster)
        best[2][x.source] += 1
    assert len(open_bins) == len(bins)


# Chat -------------------------------------------------------------------------------

def test_a_turn_beyond_the_budget_and_clashing_columns(spark):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "user", "q " * 500, 2), (1, 2, "assistant", "a " * 900, 3), (1, 2, "assistant", "a " * 900, 3), (1, 3, "user", "", 4)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long"), 100, 20)
    out = chat.read_back(windows).collect()
    assert [(x.n_turns, x.loss_chars) for x in out] == [(5, 3600)] and windows.count() > 2


# Near duplicates ------------------------------------------------------------------------

def test_every_row_repeated(spark):
    texts = [(k, f"a{k} " * 3 + " ".join(f"w{j}" for j in range(60))) for k in range(6)]
    frame = spark.createDataFrame(texts * 3, "doc_id long, text string")
    out = near_dup.near_duplicates(frame, Fraction(85, 100), 3).collect()
    assert len(out) == 18 and {(x.doc_id, x.component_id) for x in out} == {(k, 0) for k in range(6)}
    assert near_dup.deduplicate(frame).count() == 1


def test_very_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCE_RANGE", 16)
    monkeypatch.setattr(mixing, "CELLS", 4)
    rows = [(k, "w " * (1 + k % 7), f"site{k % 300:03d}" if k % 301 else None) for k in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {k: s for k, _, s in rows}
    size, taken, target = Counter(), Counter(), {}
    for x in out:
        size[source[x.doc_id]] += x["size"]
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left, rest = {}, 1.5 * sum(size.values()), list(names)
    while rest:
        full = [s for s in rest if weight[s] * left / sum(weight[x] for x in rest) > 2 * size[s]]
        want |= {s: 2 * size[s] for s in full} if full else {s: weight[s] * left / sum(weight[x] for x in rest) for s in rest}
        left -= sum(2 * size[s] for s in full)
        rest = [s for s in rest if s not in full] if full else []
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 2 for s in names)

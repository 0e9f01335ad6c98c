import hashlib
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from specweave.llm import chat, embeddings, html_text, mixing, near_dup, packing, topk, toxicity, words

WORD = r"[^\x20\x09-\x0D]+"


# MinHash near-duplicates ---------------------------------------------------------

def plain_components(texts, width, share):
    sets = {}
    for i, t in texts:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = [[f"w{r.integers(500)}" for _ in range(r.integers(2, 200))] for _ in range(12)]
    texts = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "one"), (5, " \t\x0b")]
    for k in range(120):
        w = list(base[k % 12])
        for _ in range(int(r.integers(0, 1 + len(w) // 20))):
            w[int(r.integers(len(w)))] = f"x{r.integers(500)}"
        texts.append((10 + k, " ".join(w)))
    frame = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, bands string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(frame, Fraction(85, 100), 3).collect()}
    assert got == plain_components(texts, 3, Fraction(85, 100))


def test_near_duplicates_nulls_repeats_and_empty(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(None, text), (5, text), (5, "other words here entirely and more"), (7, "other words here entirely and more"), (9, text)]
    out = {(x.doc_id, x.n_shingles): (x.component_id, x.kept) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(None, 36): (None, True), (5, 36): (5, True), (5, 2): (5, True), (7, 2): (5, False), (9, 36): (5, False)}
    kept = near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.doc_id or 0 for x in kept) == [0, 5]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketches_estimate():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:920], r.integers(0, 1 << 63, 80, dtype=np.uint64)])
    s = near_dup.odd_sketch(near_dup.minhash([a, np.sort(b), np.sort(r.integers(0, 1 << 63, 1000, dtype=np.uint64))])).view(np.uint64)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= near_dup.most_odd_bits(0.8) < np.bitwise_count(s[0] ^ s[2]).sum()


# Embeddings -------------------------------------------------------------------------

def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 16))
    x[300:500] = x[:200] + r.normal(size=(200, 16)) * 0.2
    x[500:640] = x[7]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, []), (None, [1.0] * 16)]
    got = {z.vec_id: (z.n_links, z.component_id) for z in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(900)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], 900).min(1))
        if (low == label).all():
            break
        label = low
    recall = sum(got[k][0] for k in range(900)) / linked.sum()
    assert 0.98 <= recall <= 1 and all(got[k][0] <= linked[k].sum() for k in range(900))
    assert np.mean([got[k][1] == label[k] for k in range(900)]) > 0.97
    assert got[1000] == (0, 1000) and got[1001][0] == got[1002][0] == got[1003][0] == 0 and got[None] == (0, None)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 12)) * 0.3
    x[50:70] = x[0]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(900, None), (901, [float("inf")] * 12), (None, [0.1] * 12)]
    got = [(z.query_id, z["rank"], z.vec_id, z.score) for z in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    q = np.floor(1024 * x).astype(np.int64)
    want = []
    for k in range(0, 400, 100):
        best = sorted(((-int(q[j] @ q[k]), j) for j in range(400) if j != k))[:10]
        want += [(k, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)


# Toxicity ---------------------------------------------------------------------------

def test_toxicity_learns_words_and_parts_of_words(spark):
    r = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("ta", "ri", "mo", "ke", "lu") for b in ("na", "so", "vi", "pe", "dar")]
    docs, labels = [], []
    for k in range(900):
        w = list(r.choice(plain, int(r.integers(5, 150))))
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                w[int(r.integers(len(w)))] = "vilest," if k % 2 else "grukka" + str(r.choice(plain))
        docs.append((k, " ".join(w), "x"))
        labels.append((k, None, int(toxic)))
    docs += [(1000, None, "x"), (None, "ta ri", "x"), (1001, "", "x")]
    out = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [x for x in out if x.held_out and x.doc_id < 900]
    assert len(held) > 100 and np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.95
    assert len(out) == 903 and all(0 <= x.score <= 1 for x in out)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(x.score, x.predicted) for x in toxicity.score_toxicity(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.drop_toxic(docs, none).count() == 1


def test_windows_cover_all_words():
    counts = np.array([0, 1, 64, 65, 200])
    start, length, text = toxicity.windows(counts, np.concatenate([[0], np.cumsum(counts)]))
    seen = np.zeros(counts.sum(), int)
    for s, n in zip(start, length):
        seen[s : s + n] += 1
    assert (seen > 0).all() and set(text) == set(range(5)) and (length <= toxicity.WINDOW).all()


# HTML -------------------------------------------------------------------------------

def test_blocks():
    page = '<head><title>T</title><script>x="</p>"</script></head><nav><a href="a>b">Go</a></nav><p>One <b>two<br>three &amp;  four<p>Five<!-- no --> six<style>p{}</style>'
    assert [(b[1], b[0][-1]) for b in html_text.blocks(page)] == [("T", "title"), ("Go", "nav"), ("One two three & four", "p"), ("Five six", "p")]


def test_labeller_on_pages_it_has_not_seen(spark):
    model, fresh = html_text.train(400), html_text.Generator(123)
    pages = [fresh.page() for _ in range(80)]
    kept = model.keep([p[0] for p in pages], {})
    right = np.concatenate([k == np.array(p[1], bool) for k, p in zip(kept, pages)])
    assert right.mean() > 0.97
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Big news</h1><p>This is a long text, with words. And more of them.</p></article><footer>&copy; me</footer>")]
    out = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), 400).collect()
    assert [(x.text, x.n_chars) for x in out[:3]] == [("", 0)] * 3 and out[3].text == "Big news\n\nThis is a long text, with words. And more of them."


# Mixing -----------------------------------------------------------------------------

def test_mix_targets_and_taken(spark):
    r = np.random.default_rng(6)
    rows = [(k, " ".join(["w"] * int(r.integers(0, 60))), ["b", "a", "c", None, "hot", "hot", "hot"][k % 7], k) for k in range(3000)] + [(None, "x y", "a", 0), (1, None, "b", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(frame).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(frame).collect()), key=str)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, (5, 2, 1, 5, 2)))
    want, left, open_names = {}, 1.5 * sum(size.values()), list(names)
    while open_names:
        full = [s for s in open_names if weight[s] * left / sum(weight[x] for x in open_names) > 2 * size[s]]
        if not full:
            want |= {s: weight[s] * left / sum(weight[x] for x in open_names) for s in open_names}
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
            open_names.remove(s)
    for s in names:
        mine = [x for x in out if x.source_size == size[s]]
        assert mine[0].target == pytest.approx(want[s]) and abs(sum(x.taken for x in mine) - want[s]) <= 0.03 * want[s]
    assert all(x.taken <= 2 * x["size"] for x in out)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert set(mixing.mixed(frame).columns) == set(frame.columns)


# Packing ----------------------------------------------------------------------------

def plain_best_fit(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        able = [b for b in range(len(bins)) if bins[b][0] >= size and cluster not in bins[b][2] and bins[b][1].count(source) < per_source and bins[b][0] > 0]
        if able:
            b = min(able, key=lambda b: (bins[b][0], b))
        else:
            b = len(bins)
            bins.append([capacity, [], set()])
        bins[b][0] -= size
        bins[b][1].append(source)
        bins[b][2].add(cluster)
        out.append(b)
    return out


def test_best_fit_equals_brute_force():
    r = np.random.default_rng(9)
    items = sorted(((int(r.integers(1, 50)), f"s{r.integers(3)}", int(r.integers(40))) for _ in range(400)), reverse=True)
    got, _ = packing.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 60, 2)
    assert got == plain_best_fit(items, 60, 2)


def test_pack_places_every_word_once(spark):
    rows = [(k, " ".join(["w"] * (k * 37 % 700)) + f" d{k % 50}", ["a", None, "b"][k % 3], 1) for k in range(300)] + [(None, "", "a", 1), (5, None, "a", 1), (5, "q " * 1000, None, 1)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id long"), capacity=256, shard_rows=200).collect()
    assert sum(x.n_words for x in out) == sum(len((r[1] or "").split()) for r in rows) and sum(x.bin_id is None for x in out) == 2
    for b in {x.bin_id for x in out if x.bin_id is not None}:
        mine = sorted((x for x in out if x.bin_id == b), key=lambda x: x.bin_offset)
        ends = np.cumsum([x.n_words for x in mine])
        assert ends[-1] <= 256 and [x.bin_offset for x in mine] == [0, *ends[:-1]] and len({x.cluster for x in mine}) == len(mine)


# Chat -------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    r = np.random.default_rng(2)
    say = lambda: " ".join(r.choice(["a", "</s>", "[INST]", "\\", "<s>", "b\n", "[/INST]é", "\\[INST]"], int(r.integers(0, 30))))
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], None if r.random() < 0.05 else say()) for c in range(12) for t in range(int(r.integers(1, 25)))]
    rows += [(None, 1, "assistant", "x"), (None, None, None, "y"), (3, None, "user", "null turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(frame, budget=60, history=20)
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert windows.where("window > 0 and n_repeated > 0").count() > 0
    assert all(chat.unescape(chat.escape(t)) == t and "[INST]" not in chat.escape(t) for t in ("[INST]", "\\[INST]", "a\\", "<s></s>"))


def test_slices_and_words():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "c" * 100, "", "A\x0bB"])], names=["text"])
    parts = list(words.slices(iter([batch]), "text", 90))
    assert sum(p.num_rows for p in parts) == 5
    assert [words.Ragged(p.column("text")).counts.tolist() for p in parts] and words.Ragged(parts[-1].column("text")).words[-1] == "b"

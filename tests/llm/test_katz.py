import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from specweave.llm.katz import LARGEST_DISCOUNTED, _add_up, _fans, _open, _parts, discounts, kept, katz_scores, smoothed


def brute(rows):
    """Scores by dictionaries, and the sum of probabilities in each context."""
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c, pairs = Counter(), Counter()
    context = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            w = token(t)
            c.update(w)
            for p in zip(["<", *w], [*w]):
                pairs[p] += 1
                context[p[0]] += 1
    n, v = sum(c.values()), len(c)
    uni = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    ratio = discounts([sum(x == r for x in pairs.values()) for r in range(1, LARGEST_DISCOUNTED + 2)])
    p_seen = {p: float(kept(np.array([x]), ratio)[0]) / context[p[0]] for p, x in pairs.items()}
    follow = defaultdict(list)
    for h, w in pairs:
        follow[h].append(w)
    alpha = {h: (1 - sum(p_seen[h, w] for w in ws)) / (1 - sum(map(uni, ws))) for h, ws in follow.items()}
    prob = lambda h, w: p_seen.get((h, w)) or alpha.get(h, 1.0) * uni(w)
    sums = [sum(prob(h, w) for w in [*c, "never seen"]) for h in [*follow, "never seen"]]
    out = []
    for (i, t), h in zip(rows, held):
        w = token(t)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(uni(x)) for x in w), sum(math.log10(prob(a, b)) for a, b in zip(["<", *w], w))))
    return out, sums


def test_scores_equal_brute_force_and_sum_to_one(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(["a", "B", "c", "d\n", "e", f"w{i % 7}"], r.integers(0, 40), p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05]))) for i in range(60)]
    rows += [(None, "a b c"), (3, None), (7, ""), (7, "zz yy xx " * 500)]
    want, sums = brute(rows)
    assert sums == pytest.approx([1.0] * len(sums), abs=1e-9)
    got = katz_scores(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, score string").repartition(5)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-8)


def test_parts_merged_over_several_steps_change_no_score(spark):
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.5, r.integers(0, 50)) % 90)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    want = {x.doc_id: x for x in katz_scores(docs).collect()}
    assert _fans(60, 3) == [3, 9, 27, 81] and _fans(8, 512) == [8] and _fans(600, 512) == [25, 625]
    for x in katz_scores(docs, partition_tokens=40, fan_out=3).collect():
        assert tuple(x)[:5] == tuple(want[x.doc_id])[:5] and tuple(x)[5:] == pytest.approx(tuple(want[x.doc_id])[5:], abs=1e-9)


def test_counts_beyond_32_bits():
    keys = np.array([5, 9], np.uint64)
    sent = pa.Table.from_batches([_parts(b, 1, keys, np.array([3 << 32, 1], np.int64), 1) for b in (1, 2)])
    out = _add_up(sent).to_pylist()
    assert _open(out[0]["counts"], np.int64).tolist() == [6 << 32, 2] and out[-1]["totals"][-1] == (6 << 32) + 2


def test_empty_table_and_no_training(spark):
    assert katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = katz_scores(spark.createDataFrame([(held, "a")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.base_score, row.score) == (0, 0.0, 0.0)


def test_discounts_leave_mass():
    for n in ([1000, 300, 120, 60, 40, 25], [5, 0, 0, 0, 0, 0], [0] * 6, [3, 9, 1, 1, 1, 1]):
        ratio = discounts(n)
        assert (kept(np.arange(1, 50), ratio) < np.arange(1, 50)).all() and (kept(np.arange(1, 50), ratio) > 0).all()


def test_good_turing_holds_on_corpora_with_copies(spark):
    # Training bigrams of the tables at scale 0.1, 0.01 and 0.001: copies lift the fifth count.
    for n in ([1482341, 227973, 46941, 19718, 17404, 6993], [184712, 23127, 5984, 1951, 2262, 607], [41770, 4266, 514, 265, 179, 61]):
        ratio, r = discounts(n)[1:], np.arange(1, LARGEST_DISCOUNTED + 1)
        assert (ratio > 0).all() and (ratio < 1).all() and (np.diff(ratio * r) > 0).all()
        power = np.polyfit(np.log(np.arange(1, 7)), np.log(n), 1)[0] + 1
        tail = 6**power
        assert ratio == pytest.approx(((1 + 1 / r) ** power - tail) / (1 - tail))
        assert np.ptp(r * (1 - ratio)) > 0.1  # not one constant from each count
    # Copies in texts: the scores are those of the smoothed counts.
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.6, 60) % 400) for _ in range(40)]
    rows = list(enumerate([*texts, *[" ".join(f"c{k}" for k in range(150))] * 7]))
    want, sums = brute(rows)
    got = katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.score for x in got) == pytest.approx(sorted(x[6] for x in want), abs=1e-8)
    assert sums == pytest.approx([1.0] * len(sums), abs=1e-9)


def test_smoothed_spreads_counts_over_zeros():
    assert smoothed([64, 16, 0, 4, 0, 0]) == pytest.approx(np.exp(np.polyval(np.polyfit(np.log([1, 2, 4]), np.log([64, 32 / 3, 2]), 1), np.log(np.arange(1, 7)))))
    assert smoothed([5, 0, 0, 0, 0, 0]) is None and smoothed([5, 5, 5, 5, 5, 5]) is None

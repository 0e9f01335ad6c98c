"""The two recurrent networks against plain loops and numerical gradients."""

import numpy as np
import pyarrow as pa

from specweave.llm import html_text, toxicity, words


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def small_model(seed=3):
    r = np.random.default_rng(seed)
    model = toxicity.Model(seed)
    model.p = {k: r.normal(0, 0.4, v.shape) for k, v in model.p.items()}
    x = r.normal(0, 1, (9, toxicity.INPUTS))
    ids, length = r.integers(0, 8, (4, 6)), np.array([6, 3, 1, 5])
    return model, x, np.where(np.arange(6) < length[:, None], ids, 8), length


def plain_logit(p, x, ids):
    """One window by loops over steps and units: gated recurrent units in both directions, attention, one logit."""
    n, states = toxicity.HIDDEN, []
    for d in "fb":
        h, seen = np.zeros(n), {}
        for t in range(len(ids)) if d == "f" else reversed(range(len(ids))):
            a, g = x[ids[t]] @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            new = np.zeros(n)
            for u in range(n):
                z, r = sigmoid(a[u] + g[u]), sigmoid(a[n + u] + g[n + u])
                c = np.tanh(a[2 * n + u] + r * (g[2 * n + u] + p[f"c{d}"][u]))
                new[u] = (1 - z) * c + z * h[u]
            h = seen[t] = new
        states.append([seen[t] for t in range(len(ids))])
    both = [np.concatenate([f, b]) for f, b in zip(*states)]
    e = np.array([np.tanh(s @ p["A"] + p["a"]) @ p["v"] for s in both])
    share = np.exp(e) / np.exp(e).sum()
    return sum(w * s for w, s in zip(share, both)) @ p["o"] + p["k"][0]


def test_gated_network_equals_plain_loops():
    model, x, ids, length = small_model()
    got = model.forward(model.gates(x), ids, length)
    assert np.allclose(got, [plain_logit(model.p, x, ids[k, : length[k]]) for k in range(4)], atol=1e-5)


def numerical(f, v, count=6, step=1e-3):
    r = np.random.default_rng(0)
    for at in r.choice(v.size, min(count, v.size), replace=False):
        place = np.unravel_index(at, v.shape)
        keep = v[place]
        v[place] = keep + step
        up = f()
        v[place] = keep - step
        down = f()
        v[place] = keep
        yield place, (up - down) / (2 * step)


def test_gradients_of_the_gated_network():
    model, x, ids, length = small_model()
    truth = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        z = model.forward(model.gates(x), ids, length).astype(float)
        return float((np.log1p(np.exp(z)) - truth * z).sum())

    tapes: dict = {}
    z = model.forward(model.gates(x), ids, length, tapes)
    g, d_x = model.backward(tapes, ids, sigmoid(z.astype(float)) - truth, x)
    for name, v in model.p.items():
        for place, want in numerical(loss, v):
            assert abs(g[name][place] - want) < 2e-3 + 0.02 * abs(want), (name, place)
    for place, want in numerical(loss, x, 12):
        if place[0] < 8:
            assert abs(d_x[place] - want) < 2e-3 + 0.02 * abs(want)


def test_gradients_of_the_labeller_and_spans():
    r = np.random.default_rng(1)
    model = html_text.Labeller()
    model.p = {k: r.normal(0, 0.4, v.shape) for k, v in model.p.items()}
    x, mask = r.normal(0, 1, (7, html_text.INPUTS)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    at = np.where(mask, np.array([[0, 4], [1, 5], [2, 6], [3, 0]]), 0)
    truth = r.integers(0, 2, (4, 2))

    def loss():
        z = model.forward(x, at, mask).astype(float)
        return float(((np.log1p(np.exp(z)) - truth * z) * mask).sum())

    tapes: dict = {}
    z = model.forward(x, at, mask, tapes)
    slope = np.where(mask, sigmoid(z.astype(float)) - truth, 0)
    g, d_x = model._backward(tapes, x, at, mask, slope)
    for name, v in model.p.items():
        for place, want in numerical(loss, v):
            assert abs(g[name][place] - want) < 2e-3 + 0.02 * abs(want), (name, place)
    for place, want in numerical(loss, x, 12):
        assert abs(d_x[place] - want) < 2e-3 + 0.02 * abs(want)
    for steps in (2, 4, 100):
        assert np.allclose(model.logits(x, at, mask, steps)[mask], z[mask], atol=1e-5)


def test_a_text_scores_as_its_highest_window():
    model = toxicity.Model()
    texts = ["a b c " * 90, "", "d", "e f " * 33]
    ragged = words.Ragged(pa.array(texts))
    lexicon = toxicity.Lexicon(ragged.words)
    x = np.concatenate([model.inputs(lexicon, np.arange(len(ragged.words))), np.zeros((1, toxicity.INPUTS), np.float32)])
    best = []
    for k in range(4):
        ids = ragged.ids[ragged.starts[k] : ragged.starts[k + 1]]
        parts = [ids[s : s + 64] for s in range(0, max(1, len(ids) - 32), 32)]
        best.append(max(plain_logit(model.p, x, p if len(p) else np.array([len(x) - 1])) for p in parts))
    got = model.scores(ragged)
    assert np.allclose(got[[0, 2, 3]], np.array(best)[[0, 2, 3]], atol=1e-4) and np.isfinite(got).all()

"""Toxicity by a bidirectional gated recurrent network in numpy.

A word's input joins a hashed word vector with the mean vector of its hashed
character n-grams and the strongest of their log odds. Windows of words that
overlap by half run through a GRU in either direction; attention pools the
states of a window into one logit, and a text scores as its highest window.
The first coordinate of each vector starts as smoothed log odds in the fit
sample, and training then moves all of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm import words
from specweave.runtime import tidy

WINDOW, STRIDE = 64, 32
HIDDEN, ATTENTION, DIM = 8, 8, 4
WORD_BUCKETS, CHAR_BUCKETS = 1 << 16, 1 << 17
GRAMS = (4, 5)
INPUTS = 2 * DIM + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lexicon:
    """Hashed features of distinct words: a word bucket and character buckets (CSR)."""

    def __init__(self, vocabulary: list[str], chunk: int = 1 << 14) -> None:
        parts = [self._chunk(vocabulary[lo : lo + chunk]) for lo in range(0, len(vocabulary), chunk)]
        self.word = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
        self.grams = np.concatenate([np.zeros(0, np.int32), *(p[1] for p in parts)])
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(p[2] for p in parts)]))])

    @staticmethod
    def _chunk(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, character buckets and how many of these each word has."""
        cores = [w.strip("\"'.,;:!?()[]{}<>|*#$%&-_/\\…“”„«»¡¿") for w in vocabulary]
        digest = xxhash.xxh3_64_intdigest
        encoded = [f"^{c}$".encode() for c in cores]
        word = np.fromiter((digest(b) % WORD_BUCKETS for b in encoded), np.int32, len(encoded))
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(encoded)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        owners, grams = [], []
        for n in GRAMS:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + flat[k : len(flat) - n + 1 + k]
            inside = left[: len(h)] >= n
            owners.append(owner[: len(h)][inside])
            grams.append((words.mix(h[inside]) % np.uint64(CHAR_BUCKETS)).astype(np.int32))
        own = np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(own, kind="stable")
        return word, np.concatenate([np.zeros(0, np.int32), *grams])[order], np.bincount(own, minlength=len(encoded))

    def of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Character buckets, their word's place and each word's count, of some words."""
        n = self.starts[chosen + 1] - self.starts[chosen]
        at = np.repeat(self.starts[chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.grams[at], np.repeat(np.arange(len(chosen)), n), n


def windows(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window; a text of no words has one of none."""
    n = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return starts[text] + step * STRIDE, np.minimum(WINDOW, counts[text] - step * STRIDE), text


class Model:
    """The network's parameters, its forward pass and its training."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.3: r.normal(0, scale, shape).astype(np.float32)
        self.words, self.chars = draw(WORD_BUCKETS, DIM, scale=0.05), draw(CHAR_BUCKETS, DIM, scale=0.05)
        self.odds = np.zeros(CHAR_BUCKETS, np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(INPUTS, 3 * HIDDEN)), ("U", draw(HIDDEN, 3 * HIDDEN)), ("b", np.zeros(3 * HIDDEN, np.float32)), ("c", np.zeros(HIDDEN, np.float32)))}
        self.p |= {"A": draw(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION), "o": draw(2 * HIDDEN), "k": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, lexicon: Lexicon, chosen: np.ndarray, chunk: int = 20_000) -> np.ndarray:
        out = np.zeros((len(chosen), INPUTS), np.float32)
        out[:, :DIM] = self.words[lexicon.word[chosen]]
        for lo in range(0, len(chosen), chunk):
            grams, _, n = lexicon.of(chosen[lo : lo + chunk])
            full = np.flatnonzero(n)
            if len(full):
                at = (np.cumsum(n) - n)[full]
                out[lo + full, DIM : 2 * DIM] = np.add.reduceat(self.chars[grams], at) / n[full, None]
                out[lo + full, 2 * DIM] = np.maximum.reduceat(self.odds[grams], at)
        return out

    def _run(self, d: str, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, tape: list | None = None) -> np.ndarray:
        """States (time, window, unit) of one direction; mask is None if all windows are full."""
        u, c = self.p[f"U{d}"], self.p[f"c{d}"]
        steps, h = ids.shape[1], np.zeros((len(ids), HIDDEN), np.float32)
        out = np.empty((steps, len(ids), HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, g = gates[ids[:, t]], h @ u
            zr = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            hn = g[:, 2 * HIDDEN :] + c
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hn)
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if tape is not None:
                tape.append((t, h, z, r, n, hn))
            h = out[t] = new
        return out

    def forward(self, gates: dict, ids: np.ndarray, length: np.ndarray, tapes: dict | None = None):
        full = bool((length == ids.shape[1]).all())
        mask = None if full else np.arange(ids.shape[1])[None, :] < length[:, None]
        both = np.concatenate([self._run(d, gates[d], ids, mask, None if tapes is None else tapes.setdefault(d, [])) for d in "fb"], axis=2)
        hidden = np.tanh(both @ self.p["A"] + self.p["a"])
        e = hidden @ self.p["v"]
        if mask is not None:
            e[~mask.T] = -1e9
        e -= e.max(0)
        np.exp(e, out=e)
        if mask is not None:
            e *= mask.T
        weight = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        logit = pooled @ self.p["o"] + self.p["k"][0]
        if tapes is not None:
            tapes |= {"mask": mask, "both": both, "hidden": hidden, "weight": weight, "pooled": pooled}
        return logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def backward(self, tapes: dict, ids: np.ndarray, slope: np.ndarray, x: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the inputs x, from those of the logits."""
        both, hidden, weight, mask, g = tapes["both"], tapes["hidden"], tapes["weight"], tapes["mask"], {}
        g["o"], g["k"] = tapes["pooled"].T @ slope, slope.sum(keepdims=True)
        pooled = slope[:, None] * self.p["o"]
        d_weight = np.einsum("bh,tbh->tb", pooled, both)
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        d_hidden = d_e[:, :, None] * self.p["v"] * (1 - hidden**2)
        g["v"], g["a"], g["A"] = np.einsum("tb,tba->a", d_e, hidden), d_hidden.sum((0, 1)), np.einsum("tbh,tba->ha", both, d_hidden)
        d_both = weight[:, :, None] * pooled + d_hidden @ self.p["A"].T
        d_x = np.zeros_like(x)
        for side, d in enumerate("fb"):
            u, dh = self.p[f"U{d}"], np.zeros((len(ids), HIDDEN), np.float32)
            g |= {f"U{d}": np.zeros_like(u), f"c{d}": np.zeros(HIDDEN, np.float32)}
            d_gate = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, z, r, n, hn in reversed(tapes[d]):
                dh = dh + d_both[t, :, side * HIDDEN : (side + 1) * HIDDEN]
                on = 1.0 if mask is None else mask[:, t, None]
                new = dh * on
                d_n = new * (1 - z) * (1 - n**2)
                d_z, d_r = new * (h - n) * z * (1 - z), d_n * hn * r * (1 - r)
                inner = np.concatenate([d_z, d_r, d_n * r], 1)
                g[f"U{d}"] += h.T @ inner
                g[f"c{d}"] += (d_n * r).sum(0)
                np.add.at(d_gate, ids[:, t], np.concatenate([d_z, d_r, d_n], 1))
                dh = new * z + inner @ u.T + dh * (1 - on)
            g[f"W{d}"], g[f"b{d}"] = x.T @ d_gate, d_gate.sum(0)
            d_x += d_gate @ self.p[f"W{d}"].T
        return g, d_x

    def scores(self, ragged: words.Ragged, batch: int = 4096) -> np.ndarray:
        """The highest window logit of each text."""
        lexicon = Lexicon(ragged.words)
        gates = self.gates(np.concatenate([self.inputs(lexicon, np.arange(len(ragged.words))), np.zeros((1, INPUTS), np.float32)]))
        return self._best(gates, ragged, batch)[0]

    def _best(self, gates: dict, ragged, batch: int = 4096):
        start, length, text = windows(ragged.counts, ragged.starts)
        order = np.argsort(-length, kind="stable")
        logit = np.empty(len(order), np.float32)
        ids = np.concatenate([ragged.ids, np.full(WINDOW, len(gates["f"]) - 1)])
        for lo in range(0, len(order), batch):
            w = order[lo : lo + batch]
            steps = max(1, int(length[w[0]]))
            at = np.where(np.arange(steps) < length[w, None], start[w, None] + np.arange(steps), len(ids) - 1)
            logit[w] = self.forward(gates, ids[at], length[w])
        first = np.searchsorted(text, np.arange(len(ragged.counts)))
        best = np.maximum.reduceat(logit, first) if len(first) else np.zeros(0, np.float32)
        return best, logit, start, length, text

    def fit(self, texts: list[str | None], toxic: np.ndarray, weight: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
        """Train on whole texts: each step goes through a text's highest window.

        A fifth of the texts is left out of training, and sets the scale and
        shift that make the score of a text a probability under ``weight``.
        """
        r = np.random.default_rng(seed)
        ragged = words.Ragged(pa.array(texts, pa.string()))
        lexicon = Lexicon(ragged.words)
        self._odds(lexicon, ragged, toxic)
        tuned = r.permutation(len(texts))
        held, train = tuned[: len(texts) // 5], tuned[len(texts) // 5 :]
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        seen = {"words": np.full(WORD_BUCKETS, 1e-3, np.float32), "chars": np.full(CHAR_BUCKETS, 1e-3, np.float32)}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(train)
            for lo in range(0, len(order), batch):
                docs = order[lo : lo + batch]
                part = _Part(ragged, docs)
                x = np.concatenate([self.inputs(lexicon, part.used), np.zeros((1, INPUTS), np.float32)])
                _, logit, start, length, text = self._best(self.gates(x), part)
                pick = np.lexsort((-logit, text))
                pick = pick[np.concatenate([[True], text[pick][1:] != text[pick][:-1]])]
                steps = max(1, int(length[pick].max()))
                ids = np.concatenate([part.ids, [len(x) - 1]])
                ids = ids[np.where(np.arange(steps) < length[pick, None], start[pick, None] + np.arange(steps), len(ids) - 1)]
                tapes: dict = {}
                z = self.forward(self.gates(x), ids, length[pick], tapes)
                slope = ((_sigmoid(z) - toxic[docs]) / len(docs)).astype(np.float32)
                g, d_x = self.backward(tapes, ids, slope, x)
                step += 1
                for k, v in g.items():
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    self.p[k] -= rate * (1 - epoch / epochs / 1.2) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
                self._move(lexicon, part.used, d_x[:-1], seen)
        self._calibrate(_Part(ragged, held), lexicon, toxic[held], weight[held])
        return self

    def _move(self, lexicon: Lexicon, used: np.ndarray, d_x: np.ndarray, seen: dict, rate: float = 0.02) -> None:
        """Adagrad on the vectors that a step used."""
        live = np.flatnonzero(np.abs(d_x[:, : 2 * DIM]).sum(1) > 0)
        grams, owner, n = lexicon.of(used[live])
        for name, table, rows, grad in (("words", self.words, lexicon.word[used[live]], d_x[live, :DIM]), ("chars", self.chars, grams, (d_x[live, DIM : 2 * DIM] / np.maximum(n, 1)[:, None])[owner])):
            np.add.at(seen[name], rows, (grad**2).mean(1))
            np.add.at(table, rows, -rate * grad / np.sqrt(seen[name][rows])[:, None])

    def _odds(self, lexicon: Lexicon, ragged: words.Ragged, toxic: np.ndarray, chunk: int = 50) -> None:
        """Smoothed log odds of each bucket by the number of texts with it."""
        buckets = {"words": WORD_BUCKETS, "chars": CHAR_BUCKETS}
        with_it = {name: np.zeros((2, n)) for name, n in buckets.items()}
        for lo in range(0, len(ragged.counts), chunk):
            starts = ragged.starts[lo : lo + chunk + 1]
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            pairs = np.unique(owner * np.int64(len(ragged.words)) + ragged.ids[starts[0] : starts[-1]])
            text, word = np.divmod(pairs, max(1, len(ragged.words)))
            grams, place, _ = lexicon.of(word)
            for name, bucket, owners in (("words", lexicon.word[word], text), ("chars", grams, text[place])):
                t, b = np.divmod(np.unique(owners * np.int64(buckets[name]) + bucket), buckets[name])
                for kind in (0, 1):
                    with_it[name][kind] += np.bincount(b[toxic[lo + t] == kind], minlength=buckets[name])
        for name, (n0, n1) in with_it.items():
            odds = np.log((n1 + 1) / (toxic.sum() + 2)) - np.log((n0 + 1) / ((1 - toxic).sum() + 2))
            odds = (np.clip(odds, -4, 4) * (n1 + n0) / (n1 + n0 + 10)).astype(np.float32)
            getattr(self, name)[:, 0] = odds
            if name == "chars":
                self.odds = odds

    def _calibrate(self, part, lexicon: Lexicon, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the label on the text's logit, by Newton steps."""
        if not len(toxic):
            return
        z = self._best(self.gates(np.concatenate([self.inputs(lexicon, part.used), np.zeros((1, INPUTS), np.float32)])), part)[0].astype(float)
        design, b = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
        for _ in range(30):
            q = _sigmoid(design @ b)
            gradient = design.T @ (weight * (q - toxic)) + 1e-2 * (b - [1, 0])
            hessian = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
            b = b - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        self.scale, self.shift = max(0.05, float(b[0])), float(b[1])

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit.astype(float) + self.shift)


class _Part:
    """Some texts of a Ragged, with ids into the words that they use."""

    def __init__(self, ragged: words.Ragged, docs: np.ndarray) -> None:
        flat = np.concatenate([ragged.ids[ragged.starts[d] : ragged.starts[d + 1]] for d in docs]) if len(docs) else np.zeros(0, np.int64)
        self.used, self.ids = np.unique(flat, return_inverse=True)
        self.counts = ragged.counts[docs]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])


def is_held_out(doc_id, buckets: int, bucket: int):
    """Whether crc32 of the id as text falls into a bucket; a null id doesn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(buckets)) == bucket, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 20_000) -> Model | None:
    """Fit on a bounded sample: up to ``per_class`` labelled rows of each class.

    The sample takes rows that aren't held out, whose label is 0 or 1 and
    whose text has at most ``longest`` characters, in the order of a hash of
    the id. It bounds what the one task that trains has to hold. Of rows that
    repeat an id, the highest label and the first text in order count.
    Without labels of both kinds the result is None.
    """
    able = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out("doc_id", 4, 2))
    total = {row["toxic"]: row["n"] for row in able.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    place = F.xxhash64(F.lit(11), "doc_id")
    first = [able.where(F.col("toxic") == kind).orderBy(place, "doc_id").limit(2 * per_class) for kind in (0, 1)]
    # At most 4 * per_class ids and labels, which every task can hold.
    chosen = F.broadcast(first[0].unionByName(first[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    sample = rows.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("place", place)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("place", "doc_id", "toxic", "text")), strict=True))
        kept = [r for kind in (0, 1) for r in [r for r in found if r[2] == kind][:per_class]]
        toxic = np.array([r[2] for r in kept], float)
        model = None
        if 0 < toxic.sum() < len(toxic):
            share = {kind: total[kind] / (toxic == kind).sum() for kind in (0, 1)}
            weight = np.array([share[int(y)] for y in toxic])
            model = Model().fit([r[3] for r in kept], toxic, weight / weight.mean())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(tidy(train), "model binary").first()["model"])


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3, per_class: int = 1500) -> DataFrame:
    """Return the rows of ``docs`` as ``doc_id, text, held_out, score, predicted``.

    Only the text reaches the score. Labels come from rows that aren't held
    out (crc32 of the id as text, mod 4, is not 2; a null id is not held out
    and has no label). Null and empty texts are scored as a window without
    words. Repeated rows are scored alike, other columns are ignored, and an
    empty table gives no rows. Where there are no labels of both kinds,
    nothing can be learnt and every score is 0.
    """
    model = fit_model(docs, labels, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in words.slices(batches, "text", 4 << 20):
            score = np.zeros(batch.num_rows) if net is None else net.probability(net.scores(words.Ragged(batch.column("text"))))
            yield batch.append_column("score", pa.array(score))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, text string, score double")
    return scored.select("doc_id", "text", is_held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns."""
    model = fit_model(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in words.slices(batches, "text", 4 << 20):
            keep = np.ones(batch.num_rows, bool) if net is None else net.probability(net.scores(words.Ragged(batch.column("text")))) < cut
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), schema)

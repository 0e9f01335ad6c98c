"""Main text of web pages by a recurrent block labeller in numpy.

A page becomes its sequence of leaf blocks. Each is read as the hashed tag
path above it, its hashed words and a few of its proportions; a
bidirectional LSTM runs over all blocks of the page, and labels each as
main text or not with the whole page as its context. The labeller is
trained on pages that a generator builds with known labels.
"""

from __future__ import annotations

import functools
import html
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import words
from specweave.runtime import tidy

HIDDEN, PATH_DIM, WORD_DIM, SHAPES = 12, 12, 6, 8
PATH_BUCKETS, WORD_BUCKETS = 1 << 12, 1 << 13
INPUTS = 2 * PATH_DIM + WORD_DIM + SHAPES

#: Elements whose content is no text: read up to the end tag, or nested ones. Those without an end, and those that don't end a block.
RAW = frozenset("script style noscript iframe textarea noembed noframes xmp".split())
HIDDEN_TREES = frozenset("template svg object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag closes, if that is open above it within the second set.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html")}
CLOSES = {k: (a.split(), b.split()) for k, (a, b) in CLOSES.items()}
#: Tags that can't stand in an image or a choice, and so end one that was left open.
BREAKS_OUT = frozenset("address article aside blockquote body center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())
#: Steps of a tag path that are kept: so many outermost and innermost ones.
OUTER, INNER = 40, 24

# A tag's name and attributes. A value without quotes may hold any; quotes that nothing closes are part of it.
_TAG = re.compile(r"([a-zA-Z][^\s/>]*+)((?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"([^\s/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))|[^\s/=]++|[\s/=]")
_COMMENT_END = re.compile("--!?>")
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*+>?", re.IGNORECASE) for tag in RAW | HIDDEN_TREES}
_PART = re.compile(r"[a-z]+")


class _Open:
    """The open elements of a page, with where each tag is open."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.steps: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.hidden = 0

    def push(self, tag: str, step: str) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.hidden += tag in HIDDEN_TREES
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
            self.steps.append(step)
        self.tags.append(tag)

    def cut(self, length: int) -> None:
        """Close all but the outermost ``length`` elements."""
        while len(self.tags) > length:
            tag = self.tags.pop()
            self.at[tag].pop()
            self.hidden -= tag in HIDDEN_TREES
            if tag not in INLINE:
                self.blocks.pop()
                self.steps.pop()

    def last(self, *tags: str) -> int:
        """Where the innermost of some tags is open, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def path(self) -> tuple[str, ...]:
        s = self.steps
        return tuple(s) if len(s) <= OUTER + INNER else (*s[:OUTER], *s[-INNER:])


def _step(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role."""
    if "class" in (low := attributes.lower()) or "id" in low or "role" in low:
        names = [b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes) if a.lower() in ("class", "id", "role")]
        if names:
            return f"{tag} {' '.join(names).lower()}"
    return tag


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """The leaf blocks of a page: tag path, text and characters within links.

    A path step is a tag with the words of its class, id and role; of a very
    deep path the middle is left out. Character references are decoded and
    white space runs are one space; blocks without text are left out.

    Broken markup is read as browsers do: an unclosed comment, script, style
    or tag runs to the end of the page, and a slash before ``>`` means
    nothing. Of the other elements without text, one that has no end tag any
    more is passed over, and an image or a choice left open ends at the next
    block. The time is in proportion to the length of the page.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    text: list[str] = []
    linked: list[str] = []
    opened = _Open()
    ends: dict[str, tuple[int, int]] = {}
    at, path, size = 0, (), len(page)

    def flush() -> None:
        nonlocal text, linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append((path, whole, len(" ".join(html.unescape("".join(linked)).split()))))
        text, linked = [], []

    def say(chunk: str) -> None:
        nonlocal path
        if chunk and not opened.hidden:
            if not text:
                path = opened.path()
            text.append(chunk)
            if opened.at.get("a"):
                linked.append(chunk)

    def end_of(tag: str) -> int:
        """Where the next end tag is over, or -1."""
        if ends.get(tag, (-1, 0))[0] < at:
            found = _ENDS[tag].search(page, at)
            ends[tag] = found.span() if found else (size, -1)
        return ends[tag][1]

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            say(page[at:])
            break
        say(page[at:mark])
        at = mark + 1
        closing = page.startswith("/", at)
        found = _TAG.match(page, at + closing)
        if found is None:
            after = page[at : at + 1 + closing]
            if page.startswith("!--", at):
                end = _COMMENT_END.search(page, at + 1)
                at = end.end() if end else size
            elif after[:1] in ("!", "?", "/"):
                at = (page.find(">", at) + 1) or size
            elif after.isascii() and after.isalpha():
                at = size
            else:
                say("<")
            continue
        at = found.end()
        tag = found[1].lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            say(" ")
        if closing:
            k = opened.last(tag)
            if k >= 0 and (tag not in INLINE or not opened.blocks or k > opened.blocks[-1]):
                opened.cut(k)
            continue
        if tag in RAW:
            end = end_of(tag)
            at = end if end >= 0 else size if tag in ("script", "style") else at
            continue
        if tag in VOID:
            continue
        if tag in HIDDEN_TREES and (end_of(tag) < 0 or tag == "svg" and found[2].endswith("/")):
            continue
        if tag in BREAKS_OUT and (k := opened.last("svg", "select")) >= 0 and opened.last("foreignobject") < k:
            opened.cut(min(opened.at[t][0] for t in ("svg", "select") if opened.at.get(t)))
        if tag not in INLINE:
            k = len(opened.tags)
            while k and opened.tags[k - 1] in INLINE:
                k -= 1
            opened.cut(k - 1 if k and opened.tags[k - 1] == "p" else k)
        if tag in CLOSES:
            k = opened.last(*CLOSES[tag][0])
            if k > opened.last(*CLOSES[tag][1]):
                opened.cut(k)
        opened.push(tag, _step(tag, found[2]))
    flush()
    return out


def _bucket(name: str, n: int) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) % n


class Sequences:
    """The blocks of several pages as features: CSR of path buckets and of words."""

    def __init__(self, pages: list[list[tuple[tuple[str, ...], str, int]]], cache: dict | None = None) -> None:
        cache = {} if cache is None else cache
        self.size = np.fromiter(map(len, pages), np.int64, len(pages))
        flat = [b for page in pages for b in page]
        self.texts = [b[1] for b in flat]
        steps, leaf, owner = [], [], []
        for k, (path, _, _) in enumerate(flat):
            found = cache.get(path)
            if found is None:
                if len(cache) > 50_000:
                    cache.clear()
                parts = [_bucket(f"{w}", PATH_BUCKETS) for step in path for w in _PART.findall(step)]
                last = [_bucket(f"leaf {w}", PATH_BUCKETS) for w in _PART.findall(path[-1])] if path else []
                found = cache[path] = (parts or [0], last or [1])
            steps.append(found[0])
            leaf.append(found[1])
        self.paths = [np.fromiter((b for s in group for b in s), np.int64) for group in (steps, leaf)]
        self.path_counts = [np.fromiter(map(len, group), np.int64, len(flat)) for group in (steps, leaf)]
        ragged = words.Ragged(pa.array(self.texts, pa.large_string()))
        named = words.hashes([w.strip(".,;:!?()\"'") for w in ragged.words])
        self.word = (named % np.uint64(WORD_BUCKETS)).astype(np.int64)[ragged.ids] if len(ragged.ids) else np.zeros(0, np.int64)
        self.word_counts = ragged.counts
        length = np.fromiter(map(len, self.texts), float, len(flat))
        link = np.fromiter((b[2] for b in flat), float, len(flat))
        stops = np.fromiter((t.count(".") + t.count(",") for t in self.texts), float, len(flat))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        share = place / np.maximum(1, np.repeat(self.size, self.size) - 1)
        self.shape = np.stack([np.log1p(length) / 5, np.log1p(ragged.counts) / 4, np.minimum(1, link / np.maximum(1, length)), np.minimum(1, 10 * stops / np.maximum(1, length)), share, 1 - share, np.fromiter((len(b[0]) for b in flat), float, len(flat)) / 10, np.ones(len(flat))], 1).astype(np.float32) if flat else np.zeros((0, SHAPES), np.float32)

    def padded(self, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers (time, page) of some pages, and which are real."""
        first = np.cumsum(self.size) - self.size
        steps = np.arange(int(self.size[pages].max()))[:, None]
        mask = steps < self.size[pages]
        return np.where(mask, first[pages] + steps, 0), mask


def _mean(table: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    chunk = 0
    ends = np.cumsum(counts)
    while chunk < len(full):
        # So many blocks at once that the gathered vectors stay small.
        upto = max(chunk + 1, int(np.searchsorted(ends[full], ends[full[chunk]] + 500_000)))
        some = full[chunk:upto]
        lo, hi = ends[some[0]] - counts[some[0]], ends[some[-1]]
        out[some] = np.add.reduceat(table[at[lo:hi]], (ends[some] - counts[some] - lo)) / counts[some, None]
        chunk = upto
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network, its forward pass and its training."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s, scale=0.25: r.normal(0, scale, s).astype(np.float32)
        self.tables = {"path": draw(PATH_BUCKETS, PATH_DIM), "leaf": draw(PATH_BUCKETS, PATH_DIM), "word": draw(WORD_BUCKETS, WORD_DIM, scale=0.05)}
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(INPUTS, 4 * HIDDEN)), ("U", draw(HIDDEN, 4 * HIDDEN)), ("b", np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)))}
        self.p |= {"o": draw(2 * HIDDEN), "s": draw(INPUTS, scale=0.05), "k": np.zeros(1, np.float32)}

    def inputs(self, s: Sequences) -> np.ndarray:
        return np.concatenate([_mean(self.tables["path"], s.paths[0], s.path_counts[0]), _mean(self.tables["leaf"], s.paths[1], s.path_counts[1]), _mean(self.tables["word"], s.word, s.word_counts), s.shape], 1)

    def _run(self, d: str, gates: np.ndarray, mask: np.ndarray, tape: list | None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        u = self.p[f"U{d}"]
        h, c = state or (np.zeros((gates.shape[1], HIDDEN), np.float32),) * 2
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            a = gates[t] + h @ u
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            s = np.tanh(new_c)
            on = mask[t][:, None]
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, s))
            c, h = np.where(on, new_c, c), np.where(on, o * s, h)
            out[t] = h
        return out, (h, c)

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        states = []
        for d in "fb":
            gates = (x @ self.p[f"W{d}"] + self.p[f"b{d}"])[at]
            states.append(self._run(d, gates, mask, None if tapes is None else tapes.setdefault(d, []))[0])
        both = np.concatenate(states, 2)
        if tapes is not None:
            tapes["both"] = both
        return both @ self.p["o"] + (x @ self.p["s"])[at] + self.p["k"][0]

    def _backward(self, tapes: dict, x: np.ndarray, at: np.ndarray, mask: np.ndarray, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        g = {"o": np.einsum("tb,tbh->h", slope, tapes["both"]), "k": slope.sum(keepdims=True).reshape(1)}
        on_block = np.bincount(at.ravel(), slope.ravel(), len(x)).astype(np.float32)
        g["s"], d_x = x.T @ on_block, on_block[:, None] * self.p["s"]
        for side, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            d_gate = np.zeros((len(x), 4 * HIDDEN), np.float32)
            d_u, dh, dc = np.zeros_like(u), np.zeros((at.shape[1], HIDDEN), np.float32), np.zeros((at.shape[1], HIDDEN), np.float32)
            own = slope[:, :, None] * self.p["o"][side * HIDDEN : (side + 1) * HIDDEN]
            for t, h, c, i, f, o, gg, s in reversed(tapes[d]):
                dh = dh + own[t]
                on = mask[t][:, None].astype(np.float32)
                live, lc = dh * on, dc * on
                lc = lc + live * o * (1 - s**2)
                inner = np.concatenate([lc * gg * i * (1 - i), lc * c * f * (1 - f), live * s * o * (1 - o), lc * i * (1 - gg**2)], 1)
                d_u += h.T @ inner
                np.add.at(d_gate, at[t], inner)
                dh, dc = dh * (1 - on) + inner @ u.T, dc * (1 - on) + lc * f
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = d_u, x.T @ d_gate, d_gate.sum(0)
            d_x += d_gate @ self.p[f"W{d}"].T
        return g, d_x

    def fit(self, pages: list[list], labels: list[list[int]], epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 3) -> Labeller:
        r = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        seen = {k: np.full(len(v), 1e-3, np.float32) for k, v in self.tables.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for lo in range(0, len(order), batch):
                part = [k for k in order[lo : lo + batch] if pages[k]]
                s = Sequences([pages[k] for k in part])
                truth = np.concatenate([labels[k] for k in part]).astype(np.float32)
                x = self.inputs(s)
                at, mask = s.padded(np.arange(len(part)))
                tapes: dict = {}
                z = self.forward(x, at, mask, tapes)
                slope = np.where(mask, _sigmoid(z) - truth[at], 0).astype(np.float32) / mask.sum()
                g, d_x = self._backward(tapes, x, at, mask, slope)
                step += 1
                for k, v in g.items():
                    m, q = moment[k]
                    m += 0.1 * (v - m)
                    q += 0.01 * (v * v - q)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
                offset = 0
                for name, rows, counts in (("path", s.paths[0], s.path_counts[0]), ("leaf", s.paths[1], s.path_counts[1]), ("word", s.word, s.word_counts)):
                    d = self.tables[name].shape[1]
                    grad = np.repeat(d_x[:, offset : offset + d] / np.maximum(1, counts)[:, None], counts, axis=0)
                    offset += d
                    np.add.at(seen[name], rows, (grad**2).mean(1))
                    np.add.at(self.tables[name], rows, -0.05 * grad / np.sqrt(seen[name][rows])[:, None])
        return self

    def logits(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, steps: int = 1 << 14) -> np.ndarray:
        """What ``forward`` gives, in spans of time, so that long pages hold one number a block."""
        z = (x @ self.p["s"])[at] + self.p["k"][0]
        spans = range(0, len(at), max(1, steps // at.shape[1]))
        for side, d in enumerate("fb"):
            out = self.p["o"][side * HIDDEN : (side + 1) * HIDDEN]
            state = None
            for lo in spans if d == "f" else reversed(spans):
                here = slice(lo, lo + spans.step)
                gates = (x[at[here]].reshape(-1, INPUTS) @ self.p[f"W{d}"] + self.p[f"b{d}"]).reshape(*at[here].shape, -1)
                h, state = self._run(d, gates, mask[here], None, state)
                z[here] += h @ out
        return z

    def keep(self, pages: list[list], cache: dict, cells: int = 100_000) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        s = Sequences(pages, cache)
        out = [np.zeros(n, bool) for n in s.size]
        if not len(s.texts):
            return out
        x = self.inputs(s)
        order = np.argsort(s.size, kind="stable")
        order = order[s.size[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * s.size[order[hi]] <= cells:
                hi += 1
            at, mask = s.padded(order[lo:hi])
            main = self.logits(x, at, mask) > 0
            for k, page in enumerate(order[lo:hi]):
                out[page] = main[: s.size[page], k]
            lo = hi
        return out


#: Words of the generator's boilerplate, by the kind of block (fixed values).
KINDS = {
    "menu": ("nav menu navbar navigation breadcrumb breadcrumbs topnav tabs links toc dropdown", "home about contact products services news blog menu more next previous login"),
    "header": ("header masthead topbar banner logo brand site-header tagline hero-bar", "welcome official site your daily source sign in register search"),
    "footer": ("footer copyright legal site-footer bottom colophon credits imprint", "© copyright all rights reserved privacy policy terms imprint contact"),
    "sidebar": ("sidebar aside widget related recommended popular trending tags archive recent side secondary complementary", "related popular recent posts more stories tags archive you may also like"),
    "notice": ("notice cookie consent popup modal alert gdpr overlay warning message banner disclaimer toast", "we use cookies accept decline consent this site please enable javascript"),
    "advert": ("ad ads advert advertisement sponsored promo promotion banner-ad adbox sponsor affiliate", "advertisement sponsored buy now sale off free shipping limited offer click here"),
    "form": ("form newsletter subscribe signup login search contact-form subscription", "subscribe newsletter email address submit sign up password username send"),
    "comments": ("comments comment comment-list reply replies discussion responses disqus respond thread", "reply says posted comment great article thanks agree ago likes report"),
    "share": ("share social sharing follow buttons share-bar social-links", "share tweet pin follow us facebook email print"),
}
MAIN = "article post content entry story main body text page article-body post-content entry-content main-content node richtext prose blog single"


class Generator:
    """Pages with known labels: an article amid blocks of each kind of ``KINDS``."""

    def __init__(self, seed: int = 17) -> None:
        self.r = np.random.default_rng(seed)
        parts = [a + b for a in "b c d f g l m n p r s t v th st w h".split() for b in "a e i o u é en er in on an ou".split()]
        self.lexicon = ["".join(self.r.choice(parts, self.r.integers(1, 4))) for _ in range(3000)]

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def some(self, low: int, high: int, extra: str = "", share: float = 0.0) -> str:
        n, extra_words = int(self.r.integers(low, high + 1)), extra.split()
        out = [self.pick(extra_words) if extra_words and self.r.random() < share else self.pick(self.lexicon) for _ in range(n)]
        if self.r.random() < 0.8:
            out[0] = out[0].capitalize()
            for k in range(3, len(out) - 1):
                if self.r.random() < 0.12:
                    out[k] += self.pick([",", ".", "."])
            if n > 3 or self.r.random() < 0.4:
                out[-1] += "."
        return " ".join(out)

    def label(self, names: str) -> str:
        name = self.pick(names.split())
        if self.r.random() < 0.3:
            name += self.pick(["-1", "-box", "_wrap", "-inner", " clearfix", "-area", "-list"])
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def junk(self, kind: str) -> list[str]:
        names, said = KINDS[kind]
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind) if self.r.random() < 0.6 else None
        tag = tag or self.pick(["div", "div", "section", "ul"] if kind in ("comments", "menu", "share") else ["div", "div", "section"])
        named = self.label(names) if tag in ("div", "section", "ul") or self.r.random() < 0.4 else ""
        share = 0.0 if self.r.random() < 0.5 else 0.6
        say = lambda a, b: self.some(a, b, said, share)
        inner: list[str] = []
        if tag == "ul" or kind in ("menu", "share") or (kind == "sidebar" and self.r.random() < 0.5):
            items = [f"<li><a href='#'>{say(1, 4)}</a></li>" for _ in range(int(self.r.integers(2, 9)))]
            inner = items if tag == "ul" else ["<ul>", *items, "</ul>"]
        elif kind == "comments":
            inner = [f"<h3>{say(1, 3)}</h3>"] if self.r.random() < 0.5 else []
            for _ in range(int(self.r.integers(1, 7))):
                wrap = self.label("comment comment-body reply comment-text") if self.r.random() < 0.7 else ""
                inner.append(f"<{(t := self.pick(['div', 'li', 'article']))}{wrap}><{(q := self.pick(['p', 'p', 'div', 'b']))}>{say(4, 60)}</{q}></{t}>")
        elif kind == "form":
            inner = [f"<label>{say(1, 3)}</label><input name='q'>" for _ in range(int(self.r.integers(1, 4)))] + [f"<button>{say(1, 2)}</button>", *([f"<p>{say(3, 15)}</p>"] if self.r.random() < 0.5 else [])]
        else:
            inner = [f"<{(q := self.pick(['p', 'span', 'div', 'h3', 'p']))}>{say(2, 25)}</{q}>" if self.r.random() < 0.6 else say(2, 25) for _ in range(int(self.r.integers(1, 4)))]
        return [f"<{tag}{named}>", *inner, f"</{tag}>"]

    def page(self) -> tuple[list, list[int]]:
        """The blocks of a page and their labels, found by a mark in the main text."""
        body: list[str] = []
        kinds = list(KINDS)
        for kind in ("notice", "header", "menu", "advert", "form"):
            if self.r.random() < {"menu": 0.8, "header": 0.5}.get(kind, 0.35):
                body += self.junk(kind)
        main = []
        if self.r.random() < 0.85:
            main.append(f"<h1>\x01{self.some(2, 12)}</h1>")
        for _ in range(int(self.r.integers(1, 14))):
            u = self.r.random()
            if u < 0.08:
                main += ["<ul>", *[f"<li>\x01{self.some(2, 20)}</li>" for _ in range(int(self.r.integers(2, 5)))], "</ul>"]
            elif u < 0.16:
                main.append(f"<{(t := self.pick(['h2', 'h3', 'blockquote', 'pre']))}>\x01{self.some(1, 20)}</{t}>")
            elif u < 0.24:
                main.append(f"<p><b>\x01{self.some(1, 8)}<br>")
            elif u < 0.32:
                main.append(f"<p>\x01{self.some(5, 40)} <a href='#'>{self.some(1, 5)}</a> {self.some(3, 20)}</p>")
            elif u < 0.37:
                main.append(f"<table><tr><td>\x01{self.some(1, 6)}</td><td>\x01{self.some(1, 6)}</td></tr></table>")
            elif u < 0.52:
                main.append(f"<p>\x01{self.some(1, 4)}</p>")
            else:
                main.append(f"<p>\x01{self.some(5, 120)}</p>")
            if self.r.random() < 0.06:
                main += self.junk(self.pick(["advert", "share", "sidebar", "notice", "form"]))
        tag = self.pick(["article", "article", "main", "div", "div", "section"])
        main = [f"<{tag}{self.label(MAIN) if tag in ('div', 'section') and self.r.random() < 0.8 or self.r.random() < 0.2 else ''}>", *main, *(self.junk("comments") if self.r.random() < 0.12 else []), f"</{tag}>"]
        if self.r.random() < 0.3:
            main = [f"<div{self.label('wrapper container page outer row column site layout')}>", *main, *(self.junk("sidebar") if self.r.random() < 0.4 else []), "</div>"]
        body += main
        for kind in ("share", "comments", "sidebar", "advert", "form", "notice", "footer"):
            if self.r.random() < {"footer": 0.8, "comments": 0.4}.get(kind, 0.3):
                body += self.junk(kind)
        if self.r.random() < 0.1:
            body += self.junk(self.pick(kinds))
        page = f"<html><head><title>{self.some(2, 12)}</title></head><body>{''.join(body)}</body></html>"
        found = blocks(page)
        return [(p, t.replace("\x01", "").strip(), n) for p, t, n in found], [int("\x01" in t) for _, t, _ in found]


def train(pages: int = 700) -> Labeller:
    generator = Generator()
    made = [generator.page() for _ in range(pages)]
    return Labeller().fit([m[0] for m in made], [m[1] for m in made])


@functools.cache
def _trained(spark: SparkSession, pages: int) -> Broadcast:
    """The labeller, trained in one task and once a session; it doesn't depend on input."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pages))], pa.binary())], names=["model"])

    model = spark.range(0, 1, 1, 1).mapInArrow(tidy(run), "model binary").first()["model"]
    return spark.sparkContext.broadcast(pickle.loads(model))


def extract_main_text(pages: DataFrame, training_pages: int = 700) -> DataFrame:
    """Return ``page_id, url, text, n_chars`` for each row.

    The text is the page's main blocks in order, an empty line between;
    ``n_chars`` counts its code points. A null or empty html, and a page
    without main text, give an empty one. Null ids and urls and repeated
    rows stay; other columns are ignored; an empty table gives no rows. The
    labeller is trained on ``training_pages`` generated pages, not on input.
    """
    shared = _trained(pages.sparkSession, training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in words.slices(batches, "html", 8 << 20):
            found = [blocks(h or "") for h in batch.column("html").to_pylist()]
            main = shared.value.keep(found, cache)
            texts = ["\n\n".join(b[1] for b, k in zip(f, m, strict=True) if k) for f, m in zip(found, main, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")

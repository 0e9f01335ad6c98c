"""Token counts by merging ragged arrays of symbols, rank by rank.

Texts are cut where no piece of the vocabulary can span, which leaves short
pre-tokens; each distinct one of a batch is merged once. All sequences of a
batch lie end to end in one array of symbols. In each round every sequence
finds its lowest-ranked adjacent pair and applies it, all at the same time;
what survives is counted.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm import words
from specweave.runtime import tidy

SPACE = "▁"
NO_RANK = np.int64(1 << 62)
#: Symbols that are merged together; a longer pre-token is a batch of its own.
SYMBOLS = 1 << 20


class PieceVocabulary:
    """What merging needs of a sentencepiece model of kind BPE with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        by_score = {s: k for k, s in enumerate(scores)}
        self.chars = {ord(p): i for p, i in pieces.items() if len(p) == 1}
        merges = {(pieces[p[:k]], pieces[p[k:]]): (by_score[model.get_score(i)], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces}
        self.width = model.get_piece_size() + 1
        keys = np.array([a * self.width + b for a, b in merges], np.int64)
        self._hash(keys, np.array(list(merges.values()), np.int64))
        joined = np.unique(np.array([ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.joined = joined
        size = max(self.chars) + 1
        self.symbol = np.full(size, -1, np.int64)
        self.symbol[list(self.chars)] = list(self.chars.values())

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table of the merges, an eighth full."""
        bits = max(4, int(8 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.ranks, self.results = np.full(len(self.keys), NO_RANK), np.full(len(self.keys), -1, np.int64)
        for key, slot, (rank, result) in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.ranks[slot], self.results[slot] = key, rank, result

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; NO_RANK where it doesn't merge."""
        key = left * self.width + right
        slot = self._slot(key)
        found = self.keys[slot]
        going = np.flatnonzero((found != key) & (found >= 0))
        while len(going):
            slot[going] += 1
            found = self.keys[slot[going]]
            going = going[(found != key[going]) & (found >= 0)]
        return self.ranks[slot], self.results[slot]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (with its word marks, without a prefix)."""
        out = np.zeros(len(tokens), np.int64)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        part = np.cumsum(size) // SYMBOLS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(tokens)], strict=True):
            out[lo:hi] = self._count(tokens[lo:hi], size[lo:hi])
        return out

    def _count(self, tokens: list[str], size: np.ndarray) -> np.ndarray:
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        token = np.repeat(np.arange(len(tokens)), size)
        known = self.symbol[np.minimum(points, len(self.symbol) - 1)]
        known[points >= len(self.symbol)] = -1
        length = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        total = np.bincount(token, np.where(known >= 0, 0, length), len(tokens)).astype(np.int64)
        cut = np.ones(len(points), bool)
        if len(points) > 1:
            key = points[:-1] << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
            cut[1:] = (self.joined[at] != key) | (token[1:] != token[:-1])
        sequence = np.cumsum(cut) - 1
        keep = known >= 0
        symbols, sequence, owner = known[keep], sequence[keep], token[keep]
        taken_up = merged(self, symbols, sequence)
        return total + np.bincount(owner, minlength=len(tokens)) - np.bincount(owner[taken_up], minlength=len(tokens))


def merged(vocabulary: PieceVocabulary, symbols: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """The places of symbols that merging takes up into the symbol before.

    In a round, each sequence applies its lowest-ranked pair at every place
    where it stands, from the left and without overlap. If a symbol made
    that way could merge with a neighbour at a rank as low, order matters,
    and the sequence applies only the first of those places.
    """
    if len(symbols) < 2:
        return np.zeros(0, np.int64)
    gone: list[np.ndarray] = []
    place = np.arange(len(symbols))
    rank, result = (np.append(x, y) for x, y in zip(vocabulary.look_up(symbols[:-1], symbols[1:]), (NO_RANK, -1), strict=True))
    rank[:-1][sequence[1:] != sequence[:-1]] = NO_RANK
    start = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
    count = np.diff(np.append(start, len(symbols)))
    while True:
        lowest = np.minimum.reduceat(rank, start)
        live = lowest < NO_RANK
        if not live.any():
            break
        if not live.all():
            keep = np.repeat(live, count)
            symbols, place, rank, result = symbols[keep], place[keep], rank[keep], result[keep]
            count, lowest = count[live], lowest[live]
            start = np.cumsum(count) - count
        number = np.repeat(np.arange(len(count)), count)
        at = np.flatnonzero(rank == lowest[number])
        # In a run of hits, every other one from the first.
        first = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (number[at[1:]] != number[at[:-1]])])
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        keep, changed, new = _applied(vocabulary, symbols, number, result, at)
        early = new[1] <= lowest[number[keep][changed]]
        if early.any():
            unsafe = np.zeros(len(lowest), bool)
            unsafe[number[keep][changed[early]]] = True
            at = at[np.concatenate([[True], number[at[1:]] != number[at[:-1]]]) | ~unsafe[number[at]]]
            keep, changed, new = _applied(vocabulary, symbols, number, result, at)
        gone.append(place[at + 1])
        place, rank, result = place[keep], rank[keep], result[keep]
        symbols, rank[changed], result[changed] = new
        count = np.bincount(number[keep], minlength=len(count))
        start = np.cumsum(count) - count
    return np.concatenate(gone) if gone else np.zeros(0, np.int64)


def _applied(vocabulary: PieceVocabulary, symbols: np.ndarray, number: np.ndarray, result: np.ndarray, at: np.ndarray):
    """What stays if the pairs at some places merge; the pairs that change; the symbols and those pairs' ranks and results."""
    after = symbols.copy()
    after[at] = result[at]
    keep = np.ones(len(after), bool)
    keep[at + 1] = False
    touched = np.zeros(len(after), bool)
    touched[at] = True
    now, own, touched = after[keep], number[keep], touched[keep]
    touched[:-1] |= touched[1:]
    changed = np.flatnonzero(touched)
    right = np.minimum(changed + 1, len(now) - 1)
    rank, merged_to = vocabulary.look_up(now[changed], now[right])
    rank[(right == changed) | (own[right] != own[changed])] = NO_RANK
    return keep, changed, (now, rank, merged_to)


_PIECES = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@functools.cache
def _vocabulary(model: str) -> PieceVocabulary:
    """The vocabulary, read once in each worker."""
    return PieceVocabulary(model)


def count_batch(vocabulary: PieceVocabulary, texts: pa.Array) -> np.ndarray:
    """Tokens of each text, as the library counts them."""
    texts = words.strings(texts)
    plain = pc.invert(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, SPACE), pc.starts_with(texts, " "))))
    full = pc.greater(pc.binary_length(texts), 0)
    out = np.zeros(len(texts), np.int64)
    # A text of single spaces: each word with the mark before it is a pre-token.
    where = np.flatnonzero(pc.and_(plain, full).to_numpy(zero_copy_only=False))
    if len(where):
        split = pc.split_pattern(texts.take(pa.array(where)), " ")
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        each = vocabulary.count([SPACE + w for w in coded.dictionary.to_pylist()])
        out[where] = np.add.reduceat(each[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(n) - n)
    # Runs of spaces stay with the word after them, as pieces can join both.
    where = np.flatnonzero(pc.and_(pc.invert(plain), full).to_numpy(zero_copy_only=False))
    if len(where):
        found = [_PIECES.findall(SPACE + t.replace(" ", SPACE)) for t in texts.take(pa.array(where)).to_pylist()]
        ids: dict[str, int] = {}
        flat = np.fromiter((ids.setdefault(w, len(ids)) for f in found for w in f), np.int64)
        n = np.fromiter(map(len, found), np.int64, len(found))
        out[where] = np.add.reduceat(vocabulary.count(list(ids))[flat], np.cumsum(n) - n)
    return out


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Return ``doc_id, n_bytes, n_tokens, over_limit`` for each row.

    ``model`` is the path of a sentencepiece BPE model, the same on every
    executor. A null text counts as empty, with 0 bytes and tokens; null
    and repeated ids stay as they are, other columns are ignored, and an
    empty table gives no rows. Long texts are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.gathered(batches, "text", 13 << 20):
            vocabulary = _vocabulary(model)
            texts = batch.column("text")
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(count_batch(vocabulary, texts))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

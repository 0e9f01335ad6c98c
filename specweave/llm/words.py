"""Words of whole texts as ragged numpy arrays, and the hashes built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What one Arrow batch is cut to before it is worked on; a longer text is a slice of its own.
SLICE_BYTES = 6 << 20

#: A word as SQL and Spark regular expressions see it.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice stay near ``max_bytes``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size + 64) // max_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut, to about ``max_bytes``, for work that shares more the more texts it sees at once."""
    held, size = [], 0
    for part in slices(batches, column, max_bytes):
        if held and size + part.nbytes > max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def strings(column: pa.Array) -> pa.Array:
    """The column with 64-bit offsets and nulls as empty texts.

    It is a copy: not all of Arrow's string kernels heed where a slice starts.
    """
    return pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")


class Ragged:
    """The words of each text: ``ids`` into ``words``, and ``counts`` per text."""

    def __init__(self, texts: pa.Array, lower: bool = True) -> None:
        texts = strings(texts)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = split.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        owner = np.repeat(np.arange(len(texts)), per_text)[full.to_numpy(zero_copy_only=False)]
        coded = flat.filter(full).dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])


def hashes(words: list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode(), seed) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A shingle is ``width`` successive words; a text of fewer words has its
    whole sequence as its only one, and a text without words has none.
    """
    ragged = Ragged(texts)
    word = mix(hashes(ragged.words) + np.uint64(0x9E3779B97F4A7C15))[ragged.ids] if len(ragged.ids) else np.zeros(0, np.uint64)
    n = max(0, len(word) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n])
    out = []
    for lo, hi in zip(ragged.starts[:-1], ragged.starts[1:], strict=True):
        if hi - lo >= width:
            s = np.sort(rolled[lo : hi - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif hi > lo:
            one = np.uint64([hi - lo])
            for k in range(lo, hi):
                one = mix(one * np.uint64(0xD6E8FEB86659FD93) + word[k] + np.uint64(1))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out

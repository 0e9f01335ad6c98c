"""Chat formatting in budgeted windows of whole turns.

Running sums of turn tokens choose spans of turns that fit a budget. Each
window repeats the system turn and a limited history before its new turns;
only the new assistant texts are targets of the loss, so each is one once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.words import WORD

#: Tokens (words) of a window's texts and of the history that it repeats.
BUDGET, HISTORY = 1024, 256

#: Fixed control strings of the template: a turn is OPEN role HEAD text TAIL CLOSE.
OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, (OPEN, HEAD, TAIL, CLOSE))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(HEAD)}(.*?){re.escape(TAIL + CLOSE)}", re.DOTALL)

WINDOWS = "conv_id long, window long, text string, n_repeated long, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    """A backslash after the first character breaks a control string; backslashes double."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Windows:
    """Builds the windows of one conversation from its turns, one at a time."""

    def __init__(self, conv_id, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: deque = deque()
        self.new: list[tuple[str, str, int]] = []
        self.window, self.total, self.start = 0, 0, 0
        self.before = 0

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """Take a turn; return the window before it if that is now complete."""
        out = None
        fixed = (self.system[2] if self.system else 0) + self.before
        if self.new and fixed + self.total + tokens - self.start > self.budget:
            out = self.close()
        self.new.append((role, text, tokens))
        self.total += tokens
        if role == "system" and self.system is None and self.window == 0 and len(self.new) == 1:
            self.system = (role, text, 0)
        return out

    def close(self) -> tuple:
        repeated = ([self.system] if self.system and self.window else []) + list(self.past)
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate([*repeated, *self.new]):
            head, body = f"{OPEN}{escape(role)}{HEAD}", escape(text)
            if k >= len(repeated) and role == "assistant":
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, TAIL, CLOSE]
            at += len(head) + len(body) + len(TAIL) + len(CLOSE)
        row = (self.conv_id, self.window, "".join(parts), len(repeated), starts, ends)
        # The longest run of latest turns, system turn aside, that the history holds.
        if self.system and self.window == 0:
            self.system = (self.system[0], self.system[1], self.new.pop(0)[2])
        past: deque = deque()
        self.before = 0
        for turn in reversed([*self.past, *self.new]):
            if self.before + turn[2] > self.history:
                break
            self.before += turn[2]
            past.appendleft(turn)
        self.past, self.new, self.window, self.start = past, [], self.window + 1, self.total
        return row


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "window", "text", "n_repeated", "loss_starts", "loss_ends"])


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Return the windows of each conversation, as ``WINDOWS`` names them.

    A window's text is its turns in the template, the first ``n_repeated`` of
    them repeats; ``loss_starts`` and ``loss_ends`` bound the new assistant
    texts in it, in code points. A turn is never cut: one of more tokens
    than the budget has a window of its own.

    Null texts and roles are empty; turns are in order of ``turn``, nulls
    first, ties by role and text; repeated rows are turns of their own. Rows
    with a null ``conv_id`` form one conversation. Other columns are ignored
    and an empty table gives no rows. A conversation is read as a stream, so
    that its length doesn't count against memory.
    """
    empty = F.lit("")
    text = F.coalesce(F.col("text").cast("string"), empty)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), text.alias("text"), F.regexp_count(text, F.lit(WORD)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, held = None, [], 0
        for batch in batches:
            for conv_id, role, body, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")), strict=True):
                done = []
                if current is None or current.conv_id != conv_id:
                    done += [current.close()] if current else []
                    current = _Windows(conv_id, budget, history)
                done += [w] if (w := current.add(role, body, tokens)) else []
                out += done
                held += sum(len(w[2]) for w in done)
                if held > 1 << 22:
                    yield _batch(out)
                    out, held = [], 0
        out += [current.close()] if current else []
        if out:
            yield _batch(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows alone.

    The windows of a conversation have to stand together and in order, as
    ``format_conversations`` gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows, state = [], None

        def row() -> tuple:
            conv_id, n, turns, loss, chars, formatted = state
            return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            for conv_id, text, repeated, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss_starts", "loss_ends")), strict=True):
                if state is None or state[0] != conv_id:
                    rows += [row()] if state else []
                    state = [conv_id, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for k, (role, body) in enumerate(_TURN.findall(text)):
                    if k >= repeated:
                        state[1] += 1
                        state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for lo, hi in zip(starts, ends, strict=True):
                    target = unescape(text[lo:hi])
                    state[3].update(target.encode())
                    state[4] += len(target)
                state[5] += len(text)
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_DIGESTS)
                rows = []
        rows += [row()] if state else []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_DIGESTS)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

"""Packing by minimum bin slack into fixed-length training sequences.

Each task streams its documents.  Full windows of a long document become sequences at once; what
remains of every document waits in a pool of bounded size, a multiset of lengths.  A sequence
starts with the longest waiting piece, and a subset-sum table held as one bit set per step (bit s:
some choice sums to s) finds the choice of further lengths that comes closest to the capacity;
going back through the steps gives how many of each length it takes.  The same choice is applied
as often as the counts allow.  Where no choice fills the window exactly, one more piece is cut to
fill it.  The last, unfilled window of a task is cut into sequences whose lengths are powers of
two, which need no padding.  Nothing is shuffled: a task's result depends on its own rows only.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vellum.llm.pretokens import pre_tokenizer
from vellum.llm.shared import keyed_text, vocabulary_path

CAPACITY = 2048
END_ID = 1
#: Tokens that wait for company in one task (4 bytes each).
POOL_TOKENS = 1_000_000

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum is as close to ``room`` as can be.

    ``lengths`` are the keys of ``counts`` in ascending order.  Each step doubles the number of
    equal pieces it may take, so a length of many pieces needs few steps.
    """
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for i in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, take = min(counts[length], room // length), 1
        while left > 0 and not reach & full:
            some = min(take, left)
            steps.append((length, some, reach))
            reach |= reach << (length * some) & mask
            left -= some
            take *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + some
            at -= length * some
    return used


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); ``rows`` are finished pieces with their places."""

    def __init__(self, first_sequence: int, capacity: int) -> None:
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list] = {}
        self.lengths: list[int] = []
        self.counts: dict[int, int] = {}
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self._sequence([(doc, start, ids[start: start + self.capacity], len(ids))])
        if whole < len(ids):
            self._wait((doc, whole, ids[whole:], len(ids)))

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.pool:
            self.pool[n] = []
            bisect.insort(self.lengths, n)
            self.counts[n] = 0
        self.pool[n].append(piece)
        self.counts[n] += 1
        self.waiting += n

    def _take(self, n: int) -> tuple:
        piece = self.pool[n].pop()
        self.counts[n] -= 1
        self.waiting -= n
        if not self.counts[n]:
            del self.pool[n], self.counts[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))
        return piece

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def drain(self, down_to: int) -> None:
        """Fill sequences until at most ``down_to`` tokens wait."""
        while self.waiting > down_to:
            longest = self.lengths[-1]
            self.counts[longest] -= 1
            used = best_fill(self.lengths, self.counts, self.capacity - longest)
            self.counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            slack = self.capacity - sum(n * k for n, k in used.items())
            for _ in range(min(self.counts[n] // k for n, k in used.items()) if not slack else 1):
                pieces = [self._take(n) for n, k in sorted(used.items(), reverse=True) for _ in range(k)]
                if slack and self.lengths:  # every piece left is longer than the slack
                    doc, start, ids, total = self._take(self.lengths[-1])
                    pieces.append((doc, start, ids[:slack], total))
                    self._wait((doc, start + slack, ids[slack:], total))
                elif slack:
                    self._powers(pieces)
                    return
                self._sequence(pieces)

    def _powers(self, pieces: list[tuple]) -> None:
        """The last window: sequences as long as the powers of two in its length."""
        total = sum(len(p[2]) for p in pieces)
        for bit in reversed(range(total.bit_length())):
            want, row = total & 1 << bit, []
            while want:
                doc, start, ids, n = pieces.pop(0)
                row.append((doc, start, ids[:want], n))
                if len(ids) > want:
                    pieces.insert(0, (doc, start + want, ids[want:], n))
                want -= len(row[-1][2])
            if row:
                self._sequence(row)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Every token of every document in exactly one piece of one sequence (columns: ``SCHEMA``).

    ``ids`` are a piece's ids as little-endian unsigned 32-bit numbers; ``start`` counts the
    document's ids before it, ``offset`` those before it in its sequence, without gaps.  A
    sequence is full, or its length is a power of two.  A null or empty text is its end id alone;
    a null document id stays null; repeated rows are packed each by itself; an empty table gives
    no pieces; other columns are ignored.
    """
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pre_tokenizer(path)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, np.frombuffer(tokens.ids(tokens.split(text)) + end, "<u4"))
                if packer.waiting > pool_tokens:
                    packer.drain(pool_tokens // 2)
                if len(packer.rows) >= 2000:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.drain(0)
        if packer.rows:
            yield _batch(packer.rows)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)

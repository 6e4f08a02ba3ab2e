"""Minimal acyclic transducers: sorted terms to their lexicographic ordinals, many cursors at a time."""

from __future__ import annotations

import os

import numpy as np

_BITS = np.left_shift(np.uint64(1), np.arange(256, dtype=np.uint64) % np.uint64(64))
_QUARTER = (np.arange(256) >> 6).astype(np.int64)


class Transducer:
    """Reads a term byte by byte; the numbers on its edges add up to the term's place in the sorted list.

    States hold a bitmap of the bytes that leave them (four words of 64 bits) and, for each word, their
    first edge; an edge is found by counting the bits below its byte.  State 0 is the start.
    """

    FIELDS = (("bitmap", np.uint64), ("first", np.int64), ("final", np.bool_), ("target", np.int64), ("skip", np.int64))

    def __init__(self, *arrays: np.ndarray) -> None:
        self.bitmap, self.first, self.final, self.target, self.skip = arrays

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """From ascending distinct terms that are not empty and hold no byte 0.

        States of the last term's path stay open; when the next term leaves the path, the states
        below are closed, and equal closed states are one.
        """
        closed: dict[tuple, int] = {}
        path, last = [[False, []]], b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], closed.setdefault((final, *edges), len(closed))))

        for term in terms:
            shared = len(os.path.commonprefix((last, term)))
            close(shared)
            path.extend([False, []] for _ in term[shared:])
            path[-1][0], last = True, term
        close(0)
        states = [*closed, (False, *path[0][1])]  # an edge leads to an earlier state, the start comes last
        n, edges = len(states), sum(len(s) - 1 for s in states)
        bitmap, first, final = np.zeros((n, 4), np.uint64), np.zeros((n, 4), np.int64), np.zeros(n, np.bool_)
        target, skip, held, at = np.zeros(edges, np.int64), np.zeros(edges, np.int64), [0] * n, 0
        for s, (ends, *out) in enumerate(states):
            final[s], passed = ends, int(ends)
            quarters = [byte >> 6 for byte, _ in out]
            first[s] = [at + sum(q < k for q in quarters) for k in range(4)]
            for byte, to in out:
                bitmap[s, byte >> 6] |= _BITS[byte]
                target[at], skip[at] = to, passed
                passed, at = passed + held[to], at + 1
            held[s] = passed
        return cls(bitmap[::-1].reshape(-1), first[::-1].reshape(-1), final[::-1].copy(), n - 1 - target, skip)

    def dump(self) -> bytes:
        """Lengths of the five arrays, then the arrays."""
        arrays = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in self.FIELDS]
        return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])

    @classmethod
    def load(cls, raw: bytes) -> Transducer:
        lengths, at, arrays = np.frombuffer(raw, np.int64, len(cls.FIELDS)), 8 * len(cls.FIELDS), []
        for n, (_, kind) in zip(lengths.tolist(), cls.FIELDS):
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*arrays)

    def ordinals(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ordinal of each term that begins at ``at`` in ``data`` and ends before a byte 0; else -1.

        All cursors take one byte together; those without an edge drop out, so that the work is the
        length of the prefixes that the vocabulary knows.
        """
        found, live = np.full(len(at), -1, np.int64), np.arange(len(at))
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(live):
            byte = data[at]
            ended = np.flatnonzero(byte == 0)
            if len(ended):
                ended = ended[self.final[state[ended]]]
                found[live[ended]] = total[ended]
            word = state * 4 + _QUARTER[byte]
            bits, bit = self.bitmap[word], _BITS[byte]
            go = np.flatnonzero(bits & bit)
            word, bits, bit = word[go], bits[go], bit[go]
            edge = self.first[word] + np.bitwise_count(bits & (bit - np.uint64(1)))
            live, at, total, state = live[go], at[go] + 1, total[go] + self.skip[edge], self.target[edge]
        return found

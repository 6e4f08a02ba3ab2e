"""SentencePiece encoding and decoding by suffix-array matching.

Texts of a batch are normalised and cut where no piece can reach across (before white space marks
that follow other characters); the distinct cuts are laid end to end.  A suffix array of that text,
sorted as deep as the longest piece, is made by prefix doubling.  All pieces are bisected in it at
once, which gives the range of suffixes, hence the positions, where each occurs.  Those edges
(position, length, piece) are sorted by position into a table that the relaxation reads: every cut
starts as single characters, and in each round joins the leftmost pair of neighbours whose edge has
the best score, until none is left, which is the vocabulary's own rule.  Characters without a piece
become bytes.  A task remembers the ids of cuts up to a bound, so later batches match new cuts only; memory
follows the batch and that bound, never the table.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import keyed_text, vocabulary_path

#: Characters of texts that are matched together (a longer text is matched alone).
BATCH_CHARS = 3_000_000
#: Characters of cuts that a task remembers from batch to batch before it starts anew.
SEEN_CHARS = 3_000_000
#: Pieces whose occurrences are laid out together.
PIECES_TOGETHER = 2048
#: Ids whose bytes are laid out together (a longer text's are laid out alone).
IDS_TOGETHER = 1_000_000
MARK = "▁"
#: Stands between cuts; above every character.
_BORDER = 0x110000


class Pieces:
    """The pieces of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        words = [model.id_to_piece(i) for i in size]
        bytes_ = [i for i in size if model.is_byte(i)]
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                         or model.is_unused(i))]
        if len(bytes_) != 256 or any(re.search(f"[^{MARK}]{MARK}", words[i]) for i in plain):
            raise ValueError(f"{path}: needs byte pieces, and white space marks at the start of pieces only")
        self.of_byte = np.zeros(256, np.int32)
        for i in bytes_:
            self.of_byte[int(words[i][1:-1], 16)] = i
        self.ids = np.array(plain, np.int32)
        self.lengths = np.array([len(words[i]) for i in plain])
        self.depth = int(self.lengths.max())
        self.points = np.full((len(plain), self.depth), -1, np.int64)
        for row, i in enumerate(plain):
            self.points[row, : len(words[i])] = list(map(ord, words[i]))
        best_first = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.order = np.full(model.vocab_size() + 1, len(plain), np.int32)  # the last: no piece
        self.order[best_first] = np.arange(len(plain))
        self.raw = [b"" if model.is_control(i) else words[i].replace(MARK, " ").encode() for i in size]
        for i in bytes_:
            self.raw[i] = bytes([int(words[i][1:-1], 16)])
        self.raw[model.unk_id()] = " ⁇ ".encode()
        self.spelt = pa.array(self.raw, pa.large_binary())


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the next ``depth`` characters, by prefix doubling.

    The first key packs as many characters as fit 62 bits, so few doublings follow.
    """
    known = np.unique(text)
    rank = np.searchsorted(known, text)
    n, bits = len(text), max(1, int(len(known) - 1).bit_length())
    width = 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key << bits | rank[np.minimum(np.arange(i, n + i), n - 1)]
    while width < depth:
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        key = rank * (n + 1) + rank[np.minimum(np.arange(width, n + width), n - 1)]
        width *= 2
    return np.argsort(key).astype(np.int32)


def occurrences(text: np.ndarray, suffixes: np.ndarray, points: np.ndarray, lengths: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) of the suffixes that begin with each piece, all pieces bisected together.

    ``text`` ends with as many borders as the longest piece has characters.
    """
    columns = np.arange(points.shape[1])
    inside = columns[None, :] < lengths[:, None]

    def bisect(past_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(points), np.int64), np.full(len(points), len(suffixes))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = suffixes[np.minimum(middle, len(suffixes) - 1)]
            own = text[np.minimum(at[:, None] + columns, len(text) - 1)]
            differ = (own != points) & inside
            first = differ.argmax(1)
            rows = np.arange(len(points))
            less = np.where(differ[rows, first], own[rows, first] < points[rows, first], past_equal)
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    return bisect(False), bisect(True)


def edge_table(text: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece id of every (position, length), -1 where there is none."""
    known = np.unique(text)
    possible = (np.isin(pieces.points, known) | (pieces.points < 0)).all(1)
    points, lengths, ids = pieces.points[possible], pieces.lengths[possible], pieces.ids[possible]
    table = np.full((len(text), pieces.depth + 1), -1, np.int32)
    if len(points):
        suffixes = suffix_array(text, pieces.depth)
        low, high = occurrences(text, suffixes, points, lengths)
        for i in range(0, len(points), PIECES_TOGETHER):
            part = slice(i, i + PIECES_TOGETHER)
            often = high[part] - low[part]
            at = suffixes[np.repeat(low[part] - np.cumsum(often) + often, often) + np.arange(often.sum())]
            # edges sorted by position: a distribution into one cell for each (position, length)
            table[at, np.repeat(lengths[part], often)] = np.repeat(ids[part], often)
    return table


def relax(text: np.ndarray, first: np.ndarray, table: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the symbols of all cuts; ``first`` holds the cuts' starts."""
    depth, none = pieces.depth, pieces.order[-1]
    start = np.flatnonzero(text != _BORDER)
    end = start + 1
    cut = np.searchsorted(first, start, "right") - 1
    done = []
    while len(start):
        length = end[1:] - start[:-1]
        fits = (cut[1:] == cut[:-1]) & (length <= depth)
        rank = np.full(len(start), none)
        at = np.flatnonzero(fits)
        rank[at] = pieces.order[table[start[at], length[at]]]
        heads = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
        sizes = np.diff(np.append(heads, len(start)))
        best = np.minimum.reduceat(rank, heads)
        over = np.repeat(best == none, sizes)
        done.append((start[over], end[over]))
        hits = np.flatnonzero((rank == np.repeat(best, sizes)) & ~over)
        left = hits[np.concatenate([[True], cut[hits][1:] != cut[hits][:-1]])] if len(hits) else hits
        end[left] = end[left + 1]
        keep = ~over
        keep[left + 1] = False
        start, end, cut = start[keep], end[keep], cut[keep]
    start, end = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
    order = np.argsort(start)
    return start[order], end[order]


_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Seen:
    """Cuts whose ids are known already, numbered as they came: ``ids[bounds[i]: bounds[i + 1]]`` spell cut i."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = defaultdict(itertools.count().__next__)  # numbers new cuts in order
        self.ids, self.bounds, self.chars = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def learn(self, pieces: Pieces) -> None:
        """Encode the cuts that have a number and no ids yet."""
        fresh = [*itertools.islice(self.numbers, len(self.bounds) - 1, None)]
        if fresh:
            ids, sizes = encode_cuts(fresh, pieces)
            self.ids = np.concatenate([self.ids, ids])
            self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(sizes))
            self.chars += sum(map(len, fresh))


def encode_cuts(cuts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct cuts, one after the other, and how many each has."""
    lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
    first = np.cumsum(lengths + 1) - lengths - 1
    text = np.full(int(first[-1] + lengths[-1]) + pieces.depth, _BORDER, np.int64)
    flat = np.frombuffer("".join(cuts).encode("utf-32-le"), "<u4")
    text[np.arange(len(flat)) + np.repeat(np.arange(len(cuts)), lengths)] = flat
    table = edge_table(text, pieces)
    start, end = relax(text, first, table, pieces)
    ids = table[start, end - start]
    bare = np.flatnonzero(ids < 0)  # single characters without a piece: their bytes
    if len(bare):
        spelt = [chr(c).encode() for c in text[start[bare]].tolist()]
        often = np.ones(len(ids), np.int64)
        often[bare] = list(map(len, spelt))
        where = np.cumsum(often) - often
        wide, start = np.repeat(ids, often), np.repeat(start, often)
        for at, raw in zip(where[bare].tolist(), spelt):
            wide[at: at + len(raw)] = pieces.of_byte[list(raw)]
        ids = wide
    return ids.astype(np.int32), np.diff(np.append(np.searchsorted(start, first), len(ids)))


def encode(texts: list[str], pieces: Pieces, seen: Seen | None = None) -> list[np.ndarray]:
    """Ids of every text; cuts that ``seen`` knows are not matched again, new ones are added to it."""
    seen = Seen() if seen is None else seen
    rows = [np.array([*map(seen.numbers.__getitem__, _CUT.findall(n))], np.int64)
            for n in pieces.library.normalize(texts)]
    seen.learn(pieces)
    sizes, out = np.diff(seen.bounds), []
    for row in rows:
        size = sizes[row]
        ends = np.cumsum(size)
        out.append(seen.ids[np.repeat(seen.bounds[row] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])
    return out


def decode(ids: list[int], pieces: Pieces) -> str:
    """Text of ids; bytes that make no character become replacement characters."""
    text = b"".join([pieces.raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def decoded(lists: pa.Array, pieces: Pieces, together: int = IDS_TOGETHER) -> pa.Array:
    """Texts of a column of ids, as :func:`decode` gives them; bytes are laid out for about ``together`` ids at a time."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, ends, texts, a = lists.flatten(), np.cumsum(sizes, dtype=np.int64), [], 0
    while a < len(sizes):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + together, "right")))
        spelt = pieces.spelt.take(flat.slice(done, int(ends[b - 1]) - done))
        places = np.frombuffer(spelt.buffers()[1], np.int64, len(spelt) + 1) if len(spelt) else np.zeros(1, np.int64)
        raw, cuts = spelt.buffers()[2], places[np.append(0, ends[a:b] - done)].tolist()
        for i, j in zip(cuts[:-1], cuts[1:]):
            text = raw[i:j].to_pybytes().decode("utf-8", "replace") if j > i else ""
            texts.append(text[1:] if text[:1] == " " else text)
        a = b
    return pa.array(texts, pa.string())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode_documents(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id",
                     text_col: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row, without begin and end ids.

    A null or empty text has no ids; control strings in a text are plain text; null ids stay null;
    repeated rows give repeated rows, an empty table an empty table; other columns are ignored.
    """
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = _pieces(path), Seen()

        def emit(ids, texts):
            nonlocal seen
            if seen.chars > SEEN_CHARS:
                seen = Seen()
            rows = encode(texts, pieces, seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), _lists(rows), pa.array(list(map(len, rows)), pa.int64())],
                names=["doc_id", "ids", "n_tokens"])

        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                chars += len(text)
                if chars >= batch_chars:
                    yield emit(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield emit(ids, texts)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of encoded rows; null ids decode to the empty text."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded(batch.column(1), pieces)],
                                             names=["doc_id", "ids", "n_tokens", "decoded"])

    rows = encoded.select("doc_id", F.col(ids_col).alias("ids"), "n_tokens")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")

"""Token counts: pieces counted once per distinct pre-token, joined to frequencies per document.

One pass splits every whole text into pre-tokens.  Documents are gathered in blocks of about
``BLOCK_CHARS`` characters; a block keeps, per document, the slots and frequencies of its
pre-tokens, and its distinct pre-tokens become rows (pre-token, block, slot).  Those rows are
dealt out by pre-token and sorted, each distinct one is encoded once, and its number of pieces
goes back to the slots of the blocks that hold it, a batch's worth for a block in one row.  The sum of frequency times pieces is the
count; no id sequence of a document is ever made.  What is shuffled is one row per block and
distinct pre-token, so a word that every document has costs one row per block.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.pretokens import pre_tokenizer
from vellum.llm.shared import keyed_text, vocabulary_path, work_folder

BLOCK_CHARS = 24_000_000
ROWS = 50_000

_BLOCK = "kind string, block long, slot int, term string, body binary"
_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("slot", pa.int32()),
                    ("term", pa.string()), ("body", pa.binary())])


def _emit(block: int, slots: dict[str, int], body: dict) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pylist([{"kind": "body", "block": block, "body": pickle.dumps(body, 5)}], _ARROW)
    terms = list(slots)
    for i in range(0, len(terms), ROWS):
        part = terms[i: i + ROWS]
        n = len(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["term"] * n), pa.array(np.full(n, block)), pa.array(np.arange(i, i + n, dtype=np.int32)),
             pa.array(part, pa.string()), pa.nulls(n, pa.binary())], schema=_ARROW)


def term_blocks(path: str, block_chars: int):
    """Mapper from (doc_id, text) to block bodies and their distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer(path).split
        block, n = TaskContext.get().partitionId() << 32, 0

        def fresh():
            return {}, {"docs": [], "bytes": [], "ends": [], "slots": [], "freqs": []}, 0

        slots, body, chars = fresh()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(split(text))
                body["docs"].append(doc)
                body["bytes"].append(len(text.encode()))
                body["ends"].append(len(counts))
                body["slots"].append(np.array([slots.setdefault(t, len(slots)) for t in counts], np.uint32))
                body["freqs"].append(np.array(list(counts.values()), np.uint32))
                chars += len(text)
                if chars >= block_chars:
                    yield from _emit(block + n, slots, _packed(body) | {"distinct": len(slots)})
                    slots, body, chars = fresh()
                    n += 1
        if body["docs"]:
            yield from _emit(block + n, slots, _packed(body) | {"distinct": len(slots)})

    return run


def planes(numbers: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane, which suits small ones."""
    wide = np.ascontiguousarray(numbers, "<u4")
    return zlib.compress(wide.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def numbers(packed: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def _packed(body: dict) -> dict:
    """Slots of every document as gaps in ascending order, and the frequencies in that order."""
    order = [np.argsort(s) for s in body["slots"]]
    gaps = [np.diff(s[o], prepend=np.uint32(0)) for s, o in zip(body["slots"], order)]
    freqs = [f[o] for f, o in zip(body["freqs"], order)]
    return body | {"slots": planes(np.concatenate(gaps)), "freqs": planes(np.concatenate(freqs))}


def _pieces_of(path: str):
    """Mapper from sorted (block, slot, term) to the pieces of a batch's slots, one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, n = pre_tokenizer(path).encode, None, 0
        for batch in batches:
            pieces = []
            for term in batch.column(2).to_pylist():
                if term != last:  # sorted: every distinct pre-token comes once
                    last, n = term, len(encode(term))
                pieces.append(n)
            blocks, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((slots, blocks))
            blocks, slots, pieces = blocks[order], slots[order], np.array(pieces)[order]
            found, first = np.unique(blocks, return_index=True)
            yield pa.RecordBatch.from_pylist(
                [{"block": int(block), "slots": planes(np.diff(s, prepend=0)), "pieces": planes(n)}
                 for block, s, n in zip(found, np.split(slots, first[1:]), np.split(pieces, first[1:]))],
                _PIECES)

    return run


_PIECES = pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("pieces", pa.binary())])


def _summed(bodies: pa.Table, counted: pa.Table) -> pa.Table:
    body = pickle.loads(bodies["body"][0].as_py())
    weights = np.zeros(body["distinct"], np.int64)
    for slots, pieces in zip(counted["slots"].to_pylist(), counted["pieces"].to_pylist()):
        weights[np.cumsum(numbers(slots))] = numbers(pieces)
    lengths = np.asarray(body["ends"], np.int64)
    ends = np.cumsum(lengths)
    gaps = np.cumsum(numbers(body["slots"]), dtype=np.int64)  # over all documents: take off what came before
    before = np.concatenate([[0], gaps])[ends - lengths]
    running = np.concatenate([[0], np.cumsum(weights[gaps - np.repeat(before, lengths)] * numbers(body["freqs"]))])
    return pa.table({"doc_id": pa.array(body["docs"], pa.int64()), "n_bytes": pa.array(body["bytes"], pa.int64()),
                     "n_tokens": pa.array(running[ends] - running[ends - lengths], pa.int64())})


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id",
                 text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``.

    ``n_tokens`` is what the vocabulary's library gives for the whole text without added begin or
    end tokens; special strings inside a text count as the library's default has them.  A null
    text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated
    rows; an empty table gives an empty table; other columns are ignored.  One text is never cut,
    so a block holds at least one document however long.
    """
    path, at = vocabulary_path(vocabulary), work_folder(docs.sparkSession)
    pairs = keyed_text(docs, id_col, text_col).mapInArrow(term_blocks(path, block_chars), _BLOCK)
    pairs.write.partitionBy("kind").option("compression", "zstd").parquet(at)
    blocks = docs.sparkSession.read.schema(pairs.schema).parquet(at)
    counted = (blocks.where("kind = 'term'").select("block", "slot", "term")
               .repartition("term").sortWithinPartitions("term")
               .mapInArrow(_pieces_of(path), "block long, slots binary, pieces binary"))
    return (blocks.where("kind = 'body'").select("block", "body").groupBy("block")
            .cogroup(counted.groupBy("block"))
            .applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long"))


def over_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)

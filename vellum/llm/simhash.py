"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is cut into four quarters of 16 bits.  Two fingerprints that differ in at most two
bits agree on at least two quarters, so each of the six pairs of quarters is a block key and close
fingerprints meet in some block.  Blocks of up to ``CROWD`` fingerprints are joined with
themselves and every pair is checked.  In a crowded block (a template page in thousands of
variants, say) pairs would grow with its square, so its fingerprints go another exact way: each
writes itself and its 64 one-bit neighbours, and fingerprints that share such a middle differ in
at most two bits from each other, while any two that differ in at most two bits share one.  Such a
group holds at most 65 fingerprints and needs a star instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.shared import as_table, keyed_text, work_folder, worker_memory

WORDS = 3
SEED = 42
MAX_BITS = 2
CROWD = 32
#: Texts of so many characters travel as one compressed block where whole rows must move.
BLOCK_CHARS = 8_000_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of one text, repeats counted."""
    found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not found:
        return 0
    n = len(found)
    joined = b" ".join(found)
    starts = np.zeros(n, np.int64)
    lengths = np.fromiter(map(len, found), np.int64, n)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = starts + lengths
    if n < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: n - words + 1], ends[words - 1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i: i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))],
                                             names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a signed number."""
    return keyed_text(docs, id_col, text_col).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _blocks(prints: DataFrame) -> DataFrame:
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(quarter[i], 16)).bitwiseOR(quarter[j])
            for n, (i, j) in enumerate(combinations(range(4), 2))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def close_pairs(prints: DataFrame, folder: str) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` at most two bits apart."""
    blocks = _blocks(prints)
    sizes = as_table(blocks.groupBy("key").count().where("count > 1"), f"{folder}/sizes")
    shared = blocks.join(sizes.where(F.col("count") <= CROWD), "key").select("key", "fp")
    pairs = (shared.select("key", F.col("fp").alias("a")).join(shared.select("key", F.col("fp").alias("b")), "key")
             .where((F.col("a") < F.col("b"))
                    & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b"))
    crowd = blocks.join(sizes.where(F.col("count") > CROWD).select("key"), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    middles = crowd.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("middle"))
    stars = (middles.groupBy("middle").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
             .select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a < b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: documents link when their fingerprints differ in at
    most two bits, and ``component_id`` is the least document id reachable over links.

    Null and empty texts have fingerprint zero and link like any other.  A null id stays null and
    is never a component id unless no linked row has one.  Repeated rows give repeated rows; an
    empty table gives an empty table; other columns are ignored; ties cannot occur.
    """
    folder = work_folder(docs.sparkSession)
    rows = as_table(fingerprints(docs, words, id_col, text_col), f"{folder}/fingerprints")
    return with_component(rows, folder).select("doc_id", "fp", "component_id")


def with_component(rows: DataFrame, folder: str, links=close_pairs) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with the least id reachable from each fingerprint over ``links``."""
    prints = as_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/distinct")
    roots = components(links(prints, folder))
    tied = prints.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = tied.groupBy("root").agg(F.min("first").alias("least"))
    moved = tied.join(least, "root").select("fp", "least")
    named = prints.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(named, "fp")


def row_blocks(text_at: int, marks, of: pa.DataType, block_chars: int):
    """Mapper from (doc_id, row) to blocks of rows: their ids and what ``marks`` says of their texts, and
    the rows themselves as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(dict)  # what an earlier stage has learnt goes
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).field(text_at).to_pylist()]
            of_block = np.cumsum([0, *map(len, texts)])[:-1] // block_chars
            cuts = [0, *(np.flatnonzero(np.diff(of_block)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part, sink = pa.RecordBatch.from_struct_array(batch.column(1).slice(a, b - a)), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                     pa.array([marks(texts[a:b])], pa.list_(of)), pa.array([sink.getvalue().to_pybytes()])],
                    names=["block", "ids", "prints", "body"])
                block += 1

    return run


def _chosen_rows(blocks: pa.Table, places: pa.Table) -> pa.Table:
    """The rows of one block at the given places."""
    if not blocks.num_rows:
        raise ValueError("a place without its block")
    rows = pa.ipc.open_stream(blocks["body"][0].as_buffer()).read_all()
    return rows.take(pa.array(np.sort(places["place"].to_numpy())))


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
             block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each component the document
    with the least id stays, once if its row is repeated.  Rows without an id all stay, since no
    id names them.

    Rows are written once in compressed blocks; all decisions are taken on ids, fingerprints and
    places, and the blocks meet the places that stay, so no text is shuffled or sorted unpacked.
    """
    folder = work_folder(docs.sparkSession)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))

    def prints(texts: list[str]) -> np.ndarray:
        return np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)

    blocks = as_table(whole.mapInArrow(row_blocks(docs.columns.index(text_col), prints, pa.int64(), block_chars),
                                       "block long, ids array<long>, prints array<long>, body binary"),
                      f"{folder}/blocks", "none")
    rows = as_table(blocks.select("block", F.posexplode(F.arrays_zip("ids", "prints")).alias("place", "row"))
                    .select(F.col("row.ids").alias("doc_id"), F.col("row.prints").alias("fp"), "block", "place"),
                    f"{folder}/fingerprints")
    return first_rows(blocks, rows, with_component(rows, folder), docs.schema)


def first_rows(blocks: DataFrame, rows: DataFrame, named: DataFrame, schema) -> DataFrame:
    """The rows in ``blocks`` that are the first of their component, and those without an id."""
    first = (named.where("doc_id = component_id")
             .groupBy("doc_id").agg(F.min(F.struct("block", "place")).alias("at")).select("at.block", "at.place"))
    places = first.union(rows.where("doc_id IS NULL").select("block", "place"))
    return (blocks.select("block", "body").groupBy("block").cogroup(places.groupBy("block"))
            .applyInArrow(_chosen_rows, schema))


def hex_digits(fp) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

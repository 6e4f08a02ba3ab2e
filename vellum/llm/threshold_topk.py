"""Exact top-k inner products by Fagin's threshold algorithm over shards.

Vectors are turned into integers and packed into shards of ``SHARD`` vectors where they lie.  A
shard holds one list per dimension, its vectors sorted by that component.  A query walks all lists
of a shard in step, each from the end that its own component favours, and scores every vector it
meets.  The sum of its components times the values reached bounds whatever it has not met yet:
once that bound is below its kth best score the walk ends.  (A vector that only reaches the bound
could still win a tie by its id, so equality goes on.)  Each query starts a shard with the kth best
score found in the shards before it, and only its k best of a task are shuffled.

Queries come in blocks of ``QUERIES``.  Blocks are dealt over stripes and shards over slots, up to about
``STRIPE`` and ``SLOT`` to one, and each pair of a stripe and a slot is a group of its own: every block
meets every shard once, both sides are shuffled, and neither the driver nor a task holds all queries
or all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import as_table, work_folder

SHARD = 4096
QUERIES = 256
#: Blocks of queries in a stripe, on average; shards in a slot, but for the first ``SLOTS`` slots, which hold fewer.
STRIPE, SLOT, SLOTS = 128, 8, 64
#: Places by which all lists advance before scores and bound are looked at again.
STEP = 32

_SHARDS = pa.schema([("shard", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                     ("lists", pa.binary())])
SHARDS = "shard long, dims int, ids binary, vectors binary, lists binary"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, components as floor(scale * x)."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & sound)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(vector, lambda x: F.floor(x * scale)).alias("vector")))


def _pack(size: int, lists: bool):
    """Mapper from (vec_id, vector) to shards of up to ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, waiting = TaskContext.get().partitionId() << 32, 0, {}

        def emit(dims: int):
            nonlocal n
            ids, rows = (np.array(x, np.int64) for x in zip(*waiting.pop(dims)))
            rows = rows.reshape(len(ids), dims)
            order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32) if lists else np.zeros(0, np.int32)
            n += 1
            return pa.RecordBatch.from_pylist(
                [{"shard": task + n, "dims": dims, "ids": ids.tobytes(), "vectors": rows.tobytes(),
                  "lists": order.tobytes()}], _SHARDS)

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = waiting.setdefault(len(vector), [])
                rows.append((vec_id, vector))
                if len(rows) == size:
                    yield emit(len(vector))
        for dims in list(waiting):
            yield emit(dims)

    return run


def walk(query: np.ndarray, vectors: np.ndarray, lists: np.ndarray, ids: np.ndarray, own: int, k: int,
         kth: int | None) -> tuple[list[tuple[int, int]], int]:
    """Best (score, id) of one shard that may still belong to the k best, and the vectors scored.

    ``kth`` is a score that k vectors elsewhere reach (None: no such score yet).
    """
    n, dims = vectors.shape
    best: list[tuple[int, int]] = []
    seen = np.zeros(n, bool)
    axes = np.flatnonzero(query)
    scored = at = 0
    if not len(axes):  # all scores are zero: one step over everything
        axes, step = np.arange(min(1, dims)), n
    else:
        step = STEP
    falling = query[axes] > 0
    while at < n:
        end = min(n, at + step)
        ahead = np.where(falling[:, None], lists[axes, n - end: n - at], lists[axes, at: end]) if len(axes) else \
            np.arange(n)
        new = np.unique(ahead[~seen[ahead]])
        seen[new] = True
        scored += len(new)
        scores = vectors[new] @ query
        floor = max([x for x in (kth, best[k - 1][0] if len(best) >= k else None) if x is not None], default=None)
        may = (ids[new] != own) if floor is None else (ids[new] != own) & (scores >= floor)
        if may.any():
            best = sorted([*best, *zip(scores[may].tolist(), ids[new][may].tolist())],
                          key=lambda x: (-x[0], x[1]))[:k]
        at, step = end, step * 2
        if at < n:
            reached = vectors[np.where(falling, lists[axes, n - at - 1], lists[axes, at]), axes]
            bound = int(reached @ query[axes])
            floor = max([x for x in (kth, best[k - 1][0] if len(best) >= k else None) if x is not None], default=None)
            if floor is not None and bound < floor:
                break
    return best, scored


def _search(k: int):
    """Cogroup of the shards of a slot with the blocks of a stripe: the k best of every query among these shards."""

    def run(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        for block in blocks.to_pylist() if shards.num_rows else []:
            dims, found = block["dims"], {}
            queries = list(zip(np.frombuffer(block["ids"], np.int64).tolist(),
                               np.frombuffer(block["vectors"], np.int64).reshape(-1, dims)))
            for raw_ids, raw_vectors, raw_lists in zip(*(shards[c] for c in ("ids", "vectors", "lists"))):
                ids = np.frombuffer(raw_ids.as_buffer(), np.int64)
                vectors = np.frombuffer(raw_vectors.as_buffer(), np.int64).reshape(len(ids), dims)
                lists = np.frombuffer(raw_lists.as_buffer(), np.int32).reshape(dims, len(ids))
                for q, query in queries:
                    hits = found.get(q, [])
                    kth = hits[k - 1][0] if len(hits) >= k else None
                    more, _ = walk(query, vectors, lists, ids, q, k, kth)
                    found[q] = sorted(hits + more, key=lambda x: (-x[0], x[1]))[:k]
            rows += [(q, v, s) for q, hits in found.items() for s, v in hits]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3, schema=_HITS)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    Components count as floor(scale * x).  Queries are the rows where ``is_query`` holds, candidates
    all rows of another id; ties go to the smaller id.  Rows whose id is null, and vectors that are
    null or empty or hold a null or non-finite component, take no part; vectors meet only vectors of their
    own length.  Ids are taken to be unique: a repeated query row repeats its answer once, a repeated
    candidate counts as often as it occurs.  Fewer than k candidates give fewer rows, an empty table
    none; other columns are ignored.  Scores must fit a long.
    """
    spark, folder = vectors.sparkSession, work_folder(vectors.sparkSession)
    asked = integers(vectors.where(is_query), id_col, vector_col, scale).dropDuplicates(["vec_id"])
    shards = as_table(integers(vectors, id_col, vector_col, scale).mapInArrow(_pack(shard, True), SHARDS),
                      f"{folder}/shards")
    blocks = as_table(asked.mapInArrow(_pack(QUERIES, False), SHARDS), f"{folder}/queries")
    n, stripes = shards.count(), max(1, -(-blocks.count() // STRIPE))
    slots = max(1, min(n, SLOTS), n // SLOT)

    def place(places: int) -> Column:
        return F.pmod(F.xxhash64("shard"), F.lit(places)).cast("int")

    def every(places: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(places - 1)))

    left = shards.withColumn("slot", place(slots)).withColumn("stripe", every(stripes))
    right = blocks.drop("lists").withColumn("stripe", place(stripes)).withColumn("slot", every(slots))
    dealt, search = ("dims", "slot", "stripe"), _search(k)
    hits = left.groupBy(*dealt).cogroup(right.groupBy(*dealt)).applyInArrow(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

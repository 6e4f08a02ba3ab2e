"""Exact cosine search: vectors stay put, a bounded block of queries travels to them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

QUERY_BLOCK = 128          # query vectors shipped to the tasks at a time, on average
DIGITS = 6


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0),
                       lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalised copy; the zero vector is left alone."""
    return F.when(norm(v) == 0, _double(v)).otherwise(
        F.transform(_double(v), lambda x: x / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; -1 when empty, of unequal length or of zero norm."""
    bad = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.lit(-1.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def centroids(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(query_id, vector): the component-wise mean per key, combined map-side."""
    parts = vectors.select(F.col(key).alias("query_id"), F.posexplode(_double(F.col(vector))))
    mean = parts.groupBy("query_id", "pos").agg(F.avg("col").alias("x"))
    return mean.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


class _Block:
    """Query vectors by length, ready for products with rows of vectors."""

    def __init__(self, vectors: Sequence[Sequence[float] | None]) -> None:
        self.size, self.by_length = len(vectors), {}
        for j, v in enumerate(vectors):
            own = np.array(v or (), np.float64)
            n = np.linalg.norm(own)
            if n > 0:
                self.by_length.setdefault(len(own), ([], []))[0].append(j)
                self.by_length[len(own)][1].append(own / n)
        self.by_length = {n: (js, np.array(m)) for n, (js, m) in self.by_length.items()}

    def cosines(self, lists: pa.Array) -> np.ndarray:
        """Every row with every query; -1 where a vector is missing, of another length or of norm zero."""
        out = np.full((len(lists), self.size), -1.0)
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        for n, (js, m) in self.by_length.items():
            at = np.flatnonzero(lengths == n)
            if len(at):
                rows = np.asarray(lists.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), n)
                norm = np.linalg.norm(rows, axis=1)
                at, rows = at[norm > 0], rows[norm > 0] / norm[norm > 0][:, None]
                out[np.ix_(at, js)] = rows @ m.T
        return out


def query_blocks(queries: DataFrame, *columns: str) -> Iterator[tuple[list, list[_Block]]]:
    """Ids and blocks of vectors of all queries, about ``QUERY_BLOCK`` at a time: the driver holds one block."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.select("query_id", *columns, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b"))
    for b in range(blocks):
        rows = numbered.where(F.col("_b") == b).collect()
        if rows:
            yield [r["query_id"] for r in rows], [_Block([r[c] for r in rows]) for c in columns]


def _best(sent, k: int, id_type: pa.DataType, qid_type: pa.DataType):
    """(chunk_id, embedding) to each query's ``k`` best rows of the task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weighted = sent.value
        keys, vals = [np.empty(0, dtype=object) for _ in ids], [np.empty(0) for _ in ids]
        for batch in batches:
            total = sum(w * block.cosines(batch.column(1)) for w, block in weighted)
            cid = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for j in range(len(ids)):
                s = np.concatenate([vals[j], total[:, j]])
                c = np.concatenate([keys[j], cid])
                if len(s) > k:
                    # Compare on rounded scores, so equal scores survive here and ids break ties below.
                    r = np.round(s, DIGITS)
                    edge = np.partition(r, len(r) - k)[len(r) - k]
                    keep = r >= edge
                    s, c = s[keep], c[keep]
                    if len(s) > k:
                        order = sorted(range(len(s)), key=lambda i: (-round(s[i], DIGITS), c[i]))[:k]
                        s, c = s[order], c[order]
                keys[j], vals[j] = c, s
        out = [(q, c, float(v)) for q, ks, vs in zip(ids, keys, vals) for c, v in zip(ks, vs)]
        if out:
            q, c, v = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, qid_type), pa.array(c, id_type), pa.array(v, pa.float64())],
                names=["query_id", "chunk_id", "score"])

    return local


def top_k(chunks: DataFrame, queries: DataFrame, k: int, blend: float = 1.0) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine top-k of every query.

    ``queries`` holds ``vector`` and, when ``blend`` < 1, ``second``; the score is
    ``blend * cos(vector) + (1 - blend) * cos(second)``.  A block of queries is one scan of the chunks; each
    task keeps k rows per query, and only those rows are shuffled.  No queries give no rows.
    """
    spark, qid, cid = chunks.sparkSession, queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    schema = ST.StructType([ST.StructField("query_id", qid), ST.StructField("chunk_id", cid), ST.StructField("score", ST.DoubleType())])
    columns, weights = (("vector",), (blend,)) if blend == 1.0 else (("vector", "second"), (blend, 1.0 - blend))
    out = spark.createDataFrame([], schema)
    for ids, blocks in query_blocks(queries, *columns):
        sent = spark.sparkContext.broadcast((ids, list(zip(weights, blocks))))
        out = out.union(chunks.select("chunk_id", "embedding").mapInArrow(
            _best(sent, k, to_arrow_type(cid), to_arrow_type(qid)), schema))
    scored = out.withColumn("score", F.round("score", DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint"))


def _every(sent, qid_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, block = sent.value
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                scores = block.cosines(part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(np.repeat(np.arange(part.num_rows), len(ids)))) for c in part.columns[1:]),
                     pa.array(ids * part.num_rows, qid_type), pa.array(scores.ravel())],
                    names=[*part.schema.names[1:], "query_id", "score"])

    return run


def all_scores(rows: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """(keys, query_id, score): the cosine of every row (keys, embedding) with every query (query_id, vector)."""
    qid = queries.schema["query_id"].dataType
    schema = ST.StructType([rows.schema[c] for c in keys] + [ST.StructField("query_id", qid), ST.StructField("score", ST.DoubleType())])
    out = rows.sparkSession.createDataFrame([], schema)
    for ids, (block,) in query_blocks(queries, "vector"):
        sent = rows.sparkSession.sparkContext.broadcast((ids, block))
        out = out.union(rows.select("embedding", *keys).mapInArrow(_every(sent, to_arrow_type(qid)), schema))
    return out.withColumn("score", F.round("score", DIGITS))

"""A stored inverted index for BM25, and exact top-k that leaves out blocks which cannot matter.

The corpus is dealt into slots of about ``SLOT_CHUNKS`` chunks or ``SLOT_TOKENS`` tokens, whichever is less, by a hash of the id.  Inside a slot chunks
are numbered by length, and a term's postings in it lie in the order of those numbers, each with its
gain: the part of the BM25 weight that does not depend on the query.  Okapi weighting; k1, b and the floor
for negative idf are parameters (``vocab.BM25``), and statistics always cover the whole corpus.  Every ``BLOCK`` consecutive
numbers form a block, and a posting list stores the greatest gain of each block it touches.

A search reads the postings of the asked terms only.  In every slot, and for a bounded group of queries
at a time, the block maxima give each block a bound; blocks are scored from the greatest bound on
until the bound falls below the k-th score.  So k rows for each query leave a slot, whatever its
size, and a term of a third of the corpus is spread over all slots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellum.functions import text as T, vocab
from vellum.operators import lexical

SLOT_CHUNKS, SMALL_SLOT, BLOCK = 20_000, 500, 64
#: Tokens of one slot on average, which bounds what a task holds however long the texts are.
SLOT_TOKENS = 1_000_000
#: Queries of one group, on average; groups are cut by a hash of the id.
QUERY_GROUP = 128
DIGITS = 6


@dataclass(frozen=True)
class Postings:
    """The stored tables.

    postings(slot, term, numbers, gains, blocks, maxima, ends): block ``blocks[i]`` of the list ends before
    place ``ends[i]``; the row without a term holds the slot's ``chunk_ids`` by number.  terms(term, df, idf);
    stats(n, avgdl, slots, k1, b).
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> Postings:
        return Postings(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")))


def _slot_postings(id_type: pa.DataType, k1: float, b: float):
    """Chunks of one slot (slot, chunk_id, dl, tokens, avgdl) to its posting lists."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("dl", "ascending"), ("chunk_id", "ascending")])).combine_chunks()
        n, avgdl = rows.num_rows, rows["avgdl"][0].as_py()
        lists = rows["tokens"].combine_chunks()
        dl = rows["dl"].to_numpy().astype(np.float64)
        words = lists.flatten().dictionary_encode()
        number = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
        found, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + number, return_counts=True)
        term, number = np.divmod(found, max(n, 1))
        gains = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[number] / avgdl))
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        block = number // BLOCK
        heads = np.flatnonzero(np.diff(term * (n // BLOCK + 1) + block, prepend=-1))  # each block of each list
        maxima = np.maximum.reduceat(gains, heads) if len(heads) else gains
        block_firsts = np.searchsorted(heads, firsts)
        lengths = np.diff(np.append(firsts, len(found)))
        ends = np.append(heads[1:], len(found)) - np.repeat(firsts, np.diff(np.append(block_firsts, len(heads))))

        def listed(values, cuts, kind):
            """A list for each term, after the list of the row without a term."""
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0, 0], cuts]), pa.int32()), pa.array(values, kind))

        own, theirs = np.append(firsts[1:], len(found)), np.append(block_firsts[1:], len(heads))
        ids = pa.array([rows["chunk_id"].to_pylist(), *[None] * len(firsts)], pa.list_(id_type))
        if not len(firsts):
            own = theirs = np.empty(0, np.int64)
        return pa.table({
            "slot": pa.array([key[0].as_py()] * (1 + len(firsts)), pa.int64()),
            "term": pa.array([None, *words.dictionary.take(pa.array(term[firsts])).to_pylist()], pa.string()),
            "df": pa.array(np.append(0, lengths), pa.int64()), "chunk_ids": ids,
            "numbers": listed(number, own, pa.int32()), "gains": listed(gains, own, pa.float64()),
            "blocks": listed(block[heads], theirs, pa.int32()), "maxima": listed(maxima, theirs, pa.float64()),
            "ends": listed(ends, theirs, pa.int32())})

    return run


def build(chunks: DataFrame, path: str, k1: float = vocab.BM25["k1"], b: float = vocab.BM25["b"],
          slot_chunks: int = SLOT_CHUNKS, slot_tokens: int = SLOT_TOKENS) -> Postings:
    """Index ``chunks`` (chunk_id, text, title, path_text) below ``path``, a folder that all executors share.

    Texts are cut into tokens once and dealt to their slots with their length; a slot is put in order by
    one task, which holds that slot and no more.  Chunks without a token count in n and avgdl.
    """
    spark = chunks.sparkSession
    tokens = T.search_tokens(lexical.indexed_text(F.col("text"), F.col("title"), F.col("path_text")))
    cut = chunks.select("chunk_id", tokens.alias("tokens"))
    cut.withColumn("dl", F.size("tokens")).write.mode("overwrite").parquet(f"{path}/tokens")
    rows = spark.read.parquet(f"{path}/tokens")
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    slots = max(1, -(-n // slot_chunks), -(-held // slot_tokens), min(spark.sparkContext.defaultParallelism, -(-n // SMALL_SLOT)))
    rows = rows.select(F.pmod(F.xxhash64("chunk_id"), F.lit(slots)).alias("slot"), "chunk_id", "tokens", "dl")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(slots).cast("long").alias("slots"),
                     F.lit(k1).alias("k1"), F.lit(b).alias("b"))
    avgdl = stats.select(F.coalesce("avgdl", F.lit(0.0))).first()[0]
    id_type = chunks.schema["chunk_id"].dataType
    schema = (f"slot long, term string, df long, chunk_ids array<{id_type.simpleString()}>, numbers array<int>, gains array<double>, "
              "blocks array<int>, maxima array<double>, ends array<int>")
    (rows.withColumn("avgdl", F.lit(avgdl or 1.0)).groupBy("slot").applyInArrow(_slot_postings(to_arrow_type(id_type), k1, b), schema)
     .sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings"))
    df = spark.read.parquet(f"{path}/postings").where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    raw = df.withColumn("raw", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    floor = raw.agg((F.avg("raw") * vocab.BM25["epsilon"]).alias("floor")).scalar()
    raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")).write.mode(
        "overwrite").parquet(f"{path}/terms")
    stats.write.mode("overwrite").parquet(f"{path}/stats")  # last: who finds it finds all
    return Postings.read(spark, path)


def stored(chunks: DataFrame, folder: str, corpus_name: str) -> Postings:
    """The index of ``chunks`` below ``folder``, built if it is not there.

    Its place is named by a fingerprint of every indexed value, so a corpus that has changed finds none.
    """
    mixed = F.xxhash64("chunk_id", "text", "title", "path_text").cast("decimal(38,0)")
    mark = chunks.agg(F.md5(F.concat_ws(":", F.lit(corpus_name), F.count("*"), F.sum(mixed))).alias("m")).first()["m"]
    path = f"{folder.rstrip('/')}/postings-{mark}"
    try:
        chunks.sparkSession.read.parquet(f"{path}/stats").schema
    except AnalysisException:
        return build(chunks, path)
    return Postings.read(chunks.sparkSession, path)


class _Lists:
    """The posting lists of one slot for the terms of one group of queries."""

    def __init__(self, rows: pa.Table) -> None:
        self.by_term, self.chunk_ids = {}, None
        for r in range(rows.num_rows):
            term = rows["term"][r].as_py()
            if term is None:
                self.chunk_ids = rows["chunk_ids"][r].values
            else:
                self.by_term[term] = [rows[c][r].values.to_numpy() for c in ("numbers", "gains", "blocks", "maxima", "ends")]
        self.size = 0 if self.chunk_ids is None else len(self.chunk_ids)

    def best(self, asked: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers, scores, postings read) of the chunks that can be among the ``k`` best of one query.

        Bounds leave out nothing whose rounded score could tie with the k-th.
        """
        lists = [(idf, *self.by_term[t]) for t, idf in asked if t in self.by_term]
        n_blocks, read = -(-self.size // BLOCK), 0
        bound, touched = np.zeros(n_blocks), np.zeros(n_blocks, bool)
        for idf, _, _, blocks, maxima, _ in lists:
            bound[blocks] += np.maximum(idf * maxima, 0)
            touched[blocks] = True
        order = np.flatnonzero(touched)
        order = order[np.argsort(-bound[order], kind="stable")]
        score, met, at, step, kth = np.zeros(self.size), np.zeros(self.size, bool), 0, 4, -np.inf
        while at < len(order) and bound[order[at]] >= kth - 2 * 10.0 ** -DIGITS:
            chosen = np.zeros(n_blocks, bool)
            chosen[order[at: at + step]] = True
            for idf, numbers, gains, blocks, _, ends in lists:
                own = np.flatnonzero(chosen[blocks])
                first = np.where(own > 0, ends[own - 1], 0)
                lengths = ends[own] - first
                places = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                score[numbers[places]] += idf * gains[places]
                met[numbers[places]] = True
                read += len(places)
            at, step = at + step, step * 2
            seen = score[met]
            if len(seen) >= k:
                kth = np.partition(seen, len(seen) - k)[len(seen) - k]
        found = np.flatnonzero(met & (score >= kth - 2 * 10.0 ** -DIGITS))
        return found, score[found], read


def _search(k: int, qid_type: pa.DataType, id_type: pa.DataType):
    """One slot's posting lists and one group of queries: ``k`` rows for each query."""

    def run(key: tuple, rows: pa.Table, group: pa.Table) -> pa.Table:
        lists, out = _Lists(rows), []
        for query in (q for g in group["queries"] for q in g.as_py()):
            numbers, scores, _ = lists.best([(t["term"], t["idf"]) for t in query["terms"]], k)
            if len(numbers):
                chunk = lists.chunk_ids.take(pa.array(numbers))
                ranked = pa.table({"chunk_id": chunk, "bm25": scores, "near": -np.round(scores, DIGITS)})
                ranked = ranked.take(pc.sort_indices(ranked, [("near", "ascending"), ("chunk_id", "ascending")])[:k])
                out.append(pa.table({"query_id": pa.array([query["query_id"]] * ranked.num_rows, qid_type),
                                     "chunk_id": ranked["chunk_id"].cast(id_type), "bm25": ranked["bm25"]}))
        empty = pa.table({"query_id": pa.array([], qid_type), "chunk_id": pa.array([], id_type), "bm25": pa.array([], pa.float64())})
        return pa.concat_tables(out or [empty])

    return run


def search(index: Postings, q_terms: DataFrame, k: int, group: int = QUERY_GROUP) -> DataFrame:
    """(query_id, chunk_id, bm25, rank): the exact ``k`` best chunks of every query of (query_id, term).

    Chunks that share no term with a query are not among its results; equal scores rank by id.
    """
    groups = max(1, -(-q_terms.select("query_id").distinct().count() // group))
    weighted = q_terms.distinct().join(index.terms.select("term", "idf"), "term").withColumn(
        "group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    one = weighted.groupBy("group", "query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    packed = one.groupBy("group").agg(F.collect_list(F.struct("query_id", "terms")).alias("queries")).toDF("group", "queries")
    asked = weighted.select("group", "term").distinct().union(weighted.select("group", F.lit(None).cast("string")).distinct())
    found = index.postings.alias("p").join(asked.alias("a"), F.col("p.term").eqNullSafe(F.col("a.term"))).select("p.*", "a.group")
    last = index.stats.select(F.col("slots") - 1).scalar()
    everywhere = packed.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    qid, cid = q_terms.schema["query_id"].dataType, index.postings.schema["chunk_ids"].dataType.elementType
    rows = found.groupBy("slot", "group").cogroup(everywhere.groupBy("slot", "group")).applyInArrow(
        _search(k, to_arrow_type(qid), to_arrow_type(cid)),
        f"query_id {qid.simpleString()}, chunk_id {cid.simpleString()}, bm25 double")
    return lexical.top_k(rows, k)

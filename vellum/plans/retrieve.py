"""A table of queries to ranked, packed hits in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from vellum.functions import queries as Q
from vellum.operators import context, lexical, postings, ranking, vectors
from vellum.session import ensure_checkpoint_dir


def hybrid(queries: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, top_k: int = 10, candidate_k: int = 80,
           broader: DataFrame | None = None, index: postings.Postings | None = None) -> DataFrame:
    """Vector candidates, step-back and BM25 injection, rerank.

    queries(query_id, query, vector); broader(query_id, vector) holds step-back vectors; without an
    ``index`` of the chunks the stored one is taken, or built.
    """
    q = queries.select("query_id", "query")
    found = vectors.top_k(chunk_vectors, queries.select("query_id", "vector"), 2 * max(candidate_k, top_k))
    pool = ranking.cut(ranking.adjust(found, q, chunks), candidate_k).select(
        "query_id", "chunk_id", "score", F.lit("vector").alias("lane"))
    if broader is not None:
        pool = ranking.inject(pool, vectors.top_k(chunk_vectors, broader, candidate_k + top_k), top_k, "step_back")
    index = index or postings.stored(chunks, ensure_checkpoint_dir(chunks.sparkSession), "chunks")
    keyword = postings.search(index, lexical.query_terms(q, "query"), candidate_k + 2 * top_k)
    return ranking.rerank(ranking.inject(pool, keyword, top_k, "bm25"), q, chunks)


def decomposed(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], top_k: int = 10) -> DataFrame:
    """(query_id, chunk_id, rrf_score, score, position) for the queries (query_id, query) that name topics to compare.

    Every query fans out into one focused query for each topic, all of them go through ``retrieve`` together,
    (query_id, query) to (query_id, chunk_id, score, rank), and each query's lists are fused by
    reciprocal rank.  Queries that do not decompose have no rows and are left to plain retrieval.
    """
    topics = queries.withColumn("topics", Q.sub_topics(F.col("query"))).select("*", F.posexplode("topics").alias("list_id", "topic"))
    asked = topics.select("query_id", F.col("list_id").cast("string").alias("list_id"), F.concat_ws("/", "query_id", "list_id").alias("_sub"),
                          Q.sub_query(F.col("query"), F.col("topic"), F.col("topics")).alias("query"))
    found = retrieve(asked.select(F.col("_sub").alias("query_id"), "query")).withColumnRenamed("query_id", "_sub")
    lists = found.join(asked.drop("query"), "_sub").select("query_id", "list_id", "chunk_id", "rank", "score")
    fused = lexical.top_k(ranking.reciprocal_rank_fusion(lists), top_k, "rrf_score")
    return fused.withColumnRenamed("rank", "position")


def answer_context(ranked: DataFrame, top_k: int, intent: str) -> DataFrame:
    """Novelty order, then the context pack."""
    order = ranking.novelty_order(ranked, max_select=top_k).select("query_id", "chunk_id", "position")
    return context.context_pack(ranked.join(order, ["query_id", "chunk_id"]), top_k, F.lit(intent))


def fused(lists: DataFrame, top_k: int = 10) -> DataFrame:
    """Sub-query result lists (query_id, list_id, chunk_id, rank, score) to one list per query."""
    return lexical.top_k(ranking.reciprocal_rank_fusion(lists), top_k, "rrf_score")

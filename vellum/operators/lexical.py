"""What lexical search has in common: the searchable text of a chunk, terms of queries, cuts.

The index itself is in :mod:`vellum.operators.postings`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import text as T


def indexed_text(text: Column, title: Column, path: Column) -> Column:
    """Searchable blob: body, the title five times, the section path."""
    boost = F.array_join(F.array_repeat(T.text_or_empty(title), 5), " ")
    return F.lower(F.concat_ws(" ", T.text_or_empty(text), boost, T.text_or_empty(path)))


def corpus_fingerprint(chunks: DataFrame, corpus_name: str) -> DataFrame:
    """Row count and last id identify a corpus snapshot; an index is stale when they change."""
    n, last = F.count("*"), F.max("chunk_id")
    return chunks.agg(n.alias("n"), last.alias("last_id"), F.md5(F.concat_ws(
        ":", F.lit(corpus_name), n.cast("string"), last.cast("string"))).alias("fingerprint"))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term), each term once per query."""
    return queries.select("query_id", F.explode(F.array_distinct(
        T.search_tokens(F.lower(T.text_or_empty(F.col(text)))))).alias("term"))


def top_k(scored: DataFrame, k: int, score: str = "bm25", digits: int = 6) -> DataFrame:
    """Best ``k`` chunks per query, ties by id; the rank filter sits right on the window,
    so Spark trims each partition to ``k`` rows per query before it shuffles."""
    s = scored.withColumn(score, F.round(score, digits))
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.col("chunk_id"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint"))

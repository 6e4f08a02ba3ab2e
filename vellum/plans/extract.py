"""An extraction project: pools, items, removal of duplicates, checkpoint, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vellum.operators import extraction as X, postings, prefix, ranking
from vellum.plans import retrieve, summarize
from vellum.sources import sinks


def retrieve_pools(chunks: DataFrame, chunk_vectors: DataFrame, branches: Sequence[X.Branch], embed: Callable[[Column], Column],
                   top_k: int = 50, cap: int | None = X.POOL_CAP, index: postings.Postings | None = None) -> DataFrame:
    """Pools of all branches from one hybrid retrieval: every branch is a query of the same plan.

    ``chunks`` are searchable chunks with ``source_name``, ``embed`` the model that made ``chunk_vectors``.
    """
    asked = X.branch_queries(chunks.sparkSession, branches).withColumn("vector", embed(F.col("query")))
    found = ranking.cut(retrieve.hybrid(asked, chunks, chunk_vectors, top_k, 2 * top_k, index=index), top_k)
    hits = found.select("query_id", "chunk_id", "score", "text", "source_name", "page_start")
    return X.pools_of_hits(hits, branches, cap)


def category_summaries(lines: DataFrame, categories: Sequence[str], reduce: Callable[[Column], Column] = summarize.lead_sentences,
                       budget: int = summarize.REDUCE_CHARS) -> DataFrame:
    """(category, summary) of the evidence lines (pos, branch_name, line) routed to each category, and an executive
    summary (category NULL) over them.  ``reduce`` stands for the model; layers keep its input at ``budget``
    characters however much evidence a category holds.  Lines that only a model could route are left out.
    """
    routed = X.route_categories(lines, categories).where("category IS NOT NULL").select("category", "pos", "line")
    placed = prefix.ranked(routed, ["category"], [F.col("pos"), F.col("line")], "n")
    parts = placed.select(F.col("category").alias("doc_id"), (F.col("n") - 1).alias("pos"), F.col("line").alias("text"))
    each = summarize.pyramid(parts, reduce, budget).checkpoint()
    place = F
    for i, c in enumerate(categories):
        place = place.when(F.col("doc_id") == c, F.lit(i).cast("bigint"))
    whole = each.select(F.lit("").alias("doc_id"), place.alias("pos"), F.concat_ws(": ", "doc_id", "summary").alias("text"))
    return each.withColumnRenamed("doc_id", "category").unionByName(
        summarize.pyramid(whole, reduce, budget).select(F.lit(None).cast("string").alias("category"), "summary"))


def run(chunks: DataFrame, branches: Sequence[X.Branch], base_score: Column, project: str, out: str) -> DataFrame:
    """Run every branch in one plan, write items as the checkpoint, then overrides and the report from it."""
    items = X.cap_items(X.dedup_items(X.items(X.branch_pools(chunks, branches, base_score))), branches)
    sinks.write_artifact(items, f"{out}/items")
    return rerun_report(chunks.sparkSession.read.parquet(f"{out}/items"), branches, project, out)


def rerun_report(items: DataFrame, branches: Sequence[X.Branch], project: str, out: str) -> DataFrame:
    """Reports again from checkpointed items, without retrieval."""
    overrides = X.dedup_cross_branch(items)
    sinks.write_artifact(overrides, f"{out}/overrides")
    stored = items.sparkSession.read.parquet(f"{out}/overrides")
    lines = X.report_lines(X.without_losers(items, stored), branches, project)
    sinks.write_report(lines, f"{out}/report")
    return lines

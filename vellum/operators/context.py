"""Context packing: near-duplicate removal, authority ranking, diversification, presentation order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import scoring as S, text as T, vocab
from vellum.operators import ranking as R

NEAR_DUP = 0.90
MAX_GAP = 0.06
AUTHORITY_WEIGHT = 0.20
PREFERRED_BONUS = 0.02


def drop_repeated(hits: DataFrame) -> DataFrame:
    """First hit per (query, chunk), whatever its provenance; the order is the incoming ``position``."""
    rest = [c for c in hits.columns if c not in ("query_id", "chunk_id")]
    first = hits.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct(*rest), "position").alias("_r"))
    return first.select("query_id", "chunk_id", "_r.*")


def drop_near_duplicates(hits: DataFrame, threshold: float = NEAR_DUP) -> DataFrame:
    """Greedy removal against kept hits of the same document, per query.

    A query carries at most its candidate count, so the fold's group is bounded.  Rows
    pass through the fold whole: joining ids back would compute the hits twice.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", kind="stable").reset_index(drop=True)
        kept: dict[object, list[frozenset]] = {}
        out = []
        for i, (d, toks) in enumerate(zip(pdf["doc_id"], map(frozenset, pdf["_tokens"]))):
            for seen in kept.get(d, ()):
                both = len(toks & seen)
                either = len(toks) + len(seen) - both
                if (both / either if either else 1.0) >= threshold:
                    break
            else:
                kept.setdefault(d, []).append(toks)
                out.append(i)
        return pdf.loc[out].drop(columns="_tokens")

    tokens = F.array_distinct(T.near_duplicate_tokens(F.col("text")))
    return hits.withColumn("_tokens", tokens).groupBy("query_id").applyInPandas(fold, hits.schema)


def rank_with_authority(hits: DataFrame, corpus_preferred: bool) -> DataFrame:
    """combined = score + weight x authority + bonus - position x 1e-6, ranked."""
    idx = F.row_number().over(Window.partitionBy("query_id").orderBy("position")) - 1
    bonus = PREFERRED_BONUS if corpus_preferred else 0.0
    combined = F.col("score") + AUTHORITY_WEIGHT * S.source_authority(F.col("source_type")) + bonus - idx * 1e-6
    w = Window.partitionBy("query_id").orderBy(F.desc("combined"), "chunk_id")
    return hits.withColumn("combined", F.round(combined, 9)).withColumn(
        "authority_rank", F.row_number().over(w).cast("bigint"))


def diversify(ranked: DataFrame, k: int, intent: Column) -> DataFrame:
    """First ``k`` by authority; one-document selections of eligible intents swap their last row.

    The stand-in is the first later row of another document whose raw score is within
    the gap of the last selected row's raw score.
    """
    q = Window.partitionBy("query_id")
    inside = F.col("authority_rank") <= k
    r = ranked.withColumns({
        "_n": F.count(F.when(inside, 1)).over(q), "_lo": F.min(F.when(inside, F.col("doc_id"))).over(q),
        "_hi": F.max(F.when(inside, F.col("doc_id"))).over(q)})
    r = r.withColumn("_tail", F.max(F.when(F.col("authority_rank") == F.col("_n"), F.col("score"))).over(q))
    fit = (~inside & (F.col("_lo") == F.col("_hi")) & (F.col("doc_id") != F.col("_hi"))
           & (F.col("_tail") - F.col("score") <= MAX_GAP + 1e-12) & intent.isin(*vocab.DIVERSIFY_INTENTS))
    r = r.withColumn("_alt", F.min(F.when(fit, F.col("authority_rank"))).over(q))
    chosen = F.when(F.col("_alt").isNull(), inside).otherwise(
        (F.col("authority_rank") < F.col("_n")) | (F.col("authority_rank") == F.col("_alt")))
    w = q.orderBy("authority_rank")
    return r.where(chosen).withColumn("selected_rank", F.row_number().over(w).cast("bigint")).withColumn(
        "diversified", F.col("_alt").isNotNull()).drop("_n", "_lo", "_hi", "_tail", "_alt")


def boundary_order(selected: DataFrame, rank: str = "selected_rank") -> DataFrame:
    """Strongest rows to both ends: even ranks from the front, odd ranks from the back."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    r = F.col(rank) - 1
    spread = F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2))
    return selected.withColumn("presented", F.when(n <= 2, r).otherwise(spread).cast("bigint"))


def with_web_lead(chosen: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """The web row of the best score leads; where none was chosen, the first of ``ranked`` takes the last place."""
    web = F.col("source_type") == "internet"
    none = chosen.groupBy("query_id").agg(F.max(web.cast("int")).alias("_any"), F.max("selected_rank").alias("_last")).where("_any = 0")
    w = Window.partitionBy("query_id").orderBy("authority_rank")
    late = ranked.where(web).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    # where no web row was chosen, every web row is new to the selection
    forced = late.join(none, "query_id").withColumn("selected_rank", F.col("_last")).withColumn("diversified", F.lit(False))
    taken = forced.select("query_id", F.col("_last").alias("selected_rank"))
    rows = chosen.join(taken, ["query_id", "selected_rank"], "left_anti").unionByName(forced.select(*chosen.columns))
    best = F.row_number().over(Window.partitionBy("query_id", web).orderBy(F.desc("score"), "selected_rank"))
    lead = web & (F.col("_b") == 1)
    order = Window.partitionBy("query_id").orderBy(F.desc(lead.cast("int")), "selected_rank")
    return rows.withColumn("_b", best).withColumn("selected_rank", F.row_number().over(order).cast("bigint")).drop("_b").where(
        F.col("selected_rank") <= k)


def context_pack(hits: DataFrame, k: int, intent: Column, web_first: bool = False) -> DataFrame:
    """Deduplicate, weigh by authority, select ``k``, order for presentation."""
    clean = drop_near_duplicates(drop_repeated(hits))
    ranked = rank_with_authority(clean, corpus_preferred=True)
    chosen = diversify(ranked, k, intent)
    if web_first:
        chosen = with_web_lead(chosen, ranked, k)
    return boundary_order(chosen)


def select_citations(hits: DataFrame, window: float = vocab.CITATIONS["window"],
                     minimum: int = vocab.CITATIONS["minimum"], maximum: int = vocab.CITATIONS["maximum"]) -> DataFrame:
    """Hits within ``window`` of the top score, filled up to ``minimum``, cut at ``maximum``.

    Lists are ordered by score, so both rules select a prefix.
    """
    w = Window.partitionBy("query_id").orderBy(*R.by_rank())
    lead = hits.withColumn("cite_rank", F.row_number().over(w).cast("bigint")).where(F.col("cite_rank") <= maximum)
    top = F.max("score").over(Window.partitionBy("query_id"))
    return lead.withColumn("_top", top).where((F.round(F.col("_top") - F.col("score"), 9) <= window)
                                              | (F.col("cite_rank") <= minimum)).drop("_top")


def api_citations(hits: DataFrame, cited: DataFrame, most: int = 8, width: int = 300) -> DataFrame:
    """Cited hits first, then the rest in rank order, at most ``most``, with snippets."""
    c = cited.select("query_id", "chunk_id", F.lit(True).alias("cited")).distinct()
    j = hits.join(c, ["query_id", "chunk_id"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("cited").cast("int")), *R.by_rank())
    snippet = F.concat(T.strip(F.substring("text", 1, width)), F.when(F.length("text") > width, "…").otherwise(""))
    return j.withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= most).withColumn(
        "snippet", snippet)

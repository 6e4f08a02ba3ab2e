"""Candidate lanes, injection, fusion, reranking and final ordering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as ST

from vellum.functions import queries as Q, scoring as S, text as T, vocab
from vellum.operators import lexical

# Words never proposed as feedback terms.
FEEDBACK_STOPWORDS = (
    "the a an and or but in on at to for of with by from that this it is are was were be been being "
    "have has had do does did will would could should may might must can not no nor so yet both "
    "either neither each few more most other some such than too very just also they their there "
    "which when where what who how all any into then").split()


def by_rank(score: str = "score", digits: int = 6) -> list[Column]:
    """Total order used before every cut: rounded score first, id second."""
    return [F.desc(F.round(score, digits)), F.col("chunk_id")]


def cut(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*by_rank(score))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def with_query_kinds(queries: DataFrame) -> DataFrame:
    """Query-level facts are computed once per query, not once per candidate."""
    q = F.col("query")
    return queries.withColumns({"_meta": Q.is_metadata(q), "_overview": Q.is_overview_terms(q),
                                "_numeric": Q.is_numeric(q)})


def adjust(hits: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Vector hits joined back to their rows, scores adjusted for role and term overlap."""
    j = hits.select("query_id", "chunk_id", "score").join(with_query_kinds(queries), "query_id").join(
        rows, "chunk_id")
    role = S.structural_role_score(F.col("structural_role"), F.col("token_count_est"), F.col("page_start"),
                                   F.col("_meta"), F.col("_overview"), F.col("_numeric"))
    blob = S.header_blob(F.col("title"), F.col("path_text"), F.col("text"))
    bonus = S.query_overlap_bonus(F.col("query"), blob)
    return j.withColumn("score", F.round(F.col("score") + role + bonus, 6)).drop(
        "_meta", "_overview", "_numeric")


def inject(candidates: DataFrame, ranked: DataFrame, k: int, lane: str) -> DataFrame:
    """Append per query the best ``k`` of ``ranked`` (query_id, chunk_id, rank) not yet present.

    Injected rows enter with score 0 for the reranker to judge.  A query holds at
    most as many candidates as were cut before, so ``ranked`` may itself be cut at
    that number plus ``k`` without changing the outcome.
    """
    none = F.lit(None)
    both = candidates.select("query_id", "chunk_id", "score", "lane", none.cast("bigint").alias("rank")).unionByName(
        ranked.select("query_id", "chunk_id", none.cast("double").alias("score"), none.cast("string").alias("lane"),
                      F.col("rank").cast("bigint").alias("rank")))
    merged = both.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.max("lane").alias("lane"), F.min("rank").alias("rank"))
    # One aggregate tells present rows from fresh ones, so the candidates are computed once.
    present = F.col("lane").isNotNull()
    w = Window.partitionBy("query_id", present).orderBy("rank", "chunk_id")
    return merged.withColumn("_r", F.row_number().over(w)).where(present | (F.col("_r") <= k)).select(
        "query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("lane", F.lit(lane)).alias("lane"))


def feedback_terms(candidates: DataFrame, queries: DataFrame, rows: DataFrame, top: int = 3,
                   terms: int = 5) -> DataFrame:
    """(query_id, term): frequent words of the leading hits that the query lacks."""
    lead = cut(candidates, top).select("query_id", "chunk_id")
    words = lead.join(rows.select("chunk_id", "text"), "chunk_id").select(
        "query_id", F.explode(T.search_tokens(F.lower("text"))).alias("term")).where(
        (F.length("term") >= 4) & ~F.col("term").isin(FEEDBACK_STOPWORDS))
    have = lexical.query_terms(queries, "query")
    freq = words.groupBy("query_id", "term").agg(F.count("*").alias("n")).join(
        have, ["query_id", "term"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "term")
    return freq.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= terms).select(
        "query_id", "term", F.col("_r").cast("bigint").alias("rank"))


def rerank(candidates: DataFrame, queries: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """Query-aware rerank of every candidate; a projection, no cross-row state."""
    j = candidates.join(queries, "query_id").join(rows, "chunk_id")
    score = S.rerank_score(F.col("score"), F.col("query"), F.col("text"), F.col("title"), F.col("path_text"),
                           F.col("token_count_est"), F.col("has_table"), **options)
    return j.withColumn("vector_score", F.col("score")).withColumn("score", F.round(score, 6))


def novelty_order(hits: DataFrame, penalty: float = vocab.RERANK["diversity_penalty"],
                  max_select: int | None = None) -> DataFrame:
    """Greedy novelty pass: each pick maximises score - penalty x closest Jaccard to earlier picks.

    Runs per query over hits already cut to the candidate count, so a group is
    bounded by that count whatever the corpus size.  Each round updates the running
    maximum against the newest pick only: one Jaccard per remaining row and round.
    """
    key = hits.schema["query_id"].dataType
    cid = hits.schema["chunk_id"].dataType
    schema = ST.StructType([ST.StructField("query_id", key), ST.StructField("chunk_id", cid),
                            ST.StructField("position", ST.LongType()),
                            ST.StructField("adjusted", ST.DoubleType())])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable")
        scores = pdf["score"].tolist()
        sets = [frozenset(t) for t in pdf["tokens"]]
        left, closest, picked = list(range(len(scores))), [0.0] * len(scores), []
        most = len(scores) if max_select is None else min(max_select, len(scores))
        while left and len(picked) < most:
            best = max(left, key=lambda i: (scores[i] - penalty * closest[i], -i))
            picked.append((best, scores[best] - penalty * closest[best]))
            left.remove(best)
            for i in left:
                both = len(sets[i] & sets[best])
                closest[i] = max(closest[i], both / ((len(sets[i]) + len(sets[best]) - both) or 1))
        picked += [(i, scores[i]) for i in left]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0],
                             "chunk_id": [pdf["chunk_id"].iloc[i] for i, _ in picked],
                             "position": range(1, len(picked) + 1),
                             "adjusted": [round(a, 6) for _, a in picked]})

    slim = hits.select("query_id", "chunk_id", "score",
                       F.array_distinct(T.search_tokens(F.lower("text"))).alias("tokens"))
    return slim.groupBy("query_id").applyInPandas(order, schema)


def reciprocal_rank_fusion(lists: DataFrame, k: int = vocab.RRF_K) -> DataFrame:
    """Fuse (query_id, list_id, chunk_id, rank, score), ranks from 1, into one list per query.

    The score of the list that ranked a chunk best is kept; a zero score gives way
    to the fused score.
    """
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("_rrf"),
        F.min_by("score", F.struct("rank", "list_id")).alias("_score"))
    rrf = F.round("_rrf", 6)
    return fused.select("query_id", "chunk_id", rrf.alias("rrf_score"), F.when(
        F.coalesce("_score", F.lit(0.0)) == 0, rrf).otherwise(F.col("_score")).alias("score"))


def apply_cross_scores(hits: DataFrame, logit: Column, top_n: int = vocab.CROSS_SCORER["top_n"]) -> DataFrame:
    """Blend a cross-scorer into the first ``top_n`` rows; contents pages follow the scored rows."""
    pool = hits.withColumn("_toc", F.col("structural_role") == "toc")
    order_in_pool = Window.partitionBy("query_id", "_toc").orderBy(*by_rank())
    r = pool.withColumn("_r", F.row_number().over(order_in_pool))
    scored = ~F.col("_toc") & (F.col("_r") <= top_n)
    out = r.withColumn("score", F.round(F.when(scored, S.cross_blend(F.col("score"), logit))
                                        .otherwise(F.col("score")), 6))
    bucket = F.when(scored, 0).when(F.col("_toc"), 1).otherwise(2)
    final = Window.partitionBy("query_id").orderBy(bucket, *by_rank())
    return out.withColumn("position", F.row_number().over(final).cast("bigint")).drop("_toc", "_r")


def clamp_keeping(hits: DataFrame, k: int, keep: Column) -> DataFrame:
    """Cut to ``k`` rows per query, rows marked ``keep`` first, then order by score."""
    w = Window.partitionBy("query_id").orderBy(F.desc(keep.cast("int")), *by_rank())
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def second_pass(hits: DataFrame, found: DataFrame, most: int, k: int) -> DataFrame:
    """(query_id, chunk_id, score, boosted, position): hits joined by the ``most`` best rows of a pass of their own.

    ``found`` comes from a search restricted to one kind of source, so that a small kind is heard beside a large
    one.  Rows that are hits already are not taken again; the cut to ``k`` keeps the joined rows first.
    """
    new = found.select("query_id", "chunk_id", "score").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = hits.select("query_id", "chunk_id", "score", F.lit(False).alias("boosted")).unionByName(
        cut(new, most).withColumn("boosted", F.lit(True)))
    w = Window.partitionBy("query_id").orderBy(*by_rank())
    return clamp_keeping(both, k, F.col("boosted")).withColumn("position", F.row_number().over(w).cast("bigint"))


def score_gaps(hits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Top score, its lead over the runner-up (1.0 when there is none) and the top row's ``carry`` columns.

    The two best rows are found with a rank limit; no query's whole list is sorted.
    """
    two = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_rank()))).where(
        F.col("_r") <= 2)
    first = F.col("_r") == 1
    top, second = F.max(F.when(first, F.col("score"))), F.max(F.when(~first, F.col("score")))
    return two.groupBy("query_id").agg(
        top.alias("top_score"), F.coalesce(F.round(top - second, 6), F.lit(1.0)).alias("score_gap"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in carry])


def merge_local_and_web(local: DataFrame, web: DataFrame, k: int, web_first: bool = True) -> DataFrame:
    """Union without repeated ids (best score wins), web rows first when asked, first ``k`` per query."""
    both = local.withColumn("is_web", F.lit(False)).unionByName(web.withColumn("is_web", F.lit(True)))
    best = both.groupBy("query_id", "chunk_id").agg(
        F.max_by(F.struct("score", "is_web"), F.struct("score", ~F.col("is_web"))).alias("h")).select(
        "query_id", "chunk_id", "h.*")
    order = ([F.desc(F.col("is_web").cast("int"))] if web_first else []) + by_rank()
    w = Window.partitionBy("query_id").orderBy(*order)
    return best.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).withColumn(
        "position", F.col("position").cast("bigint"))


def force_one_web_row(ranked: DataFrame, k: int) -> DataFrame:
    """First ``k`` rows per query; when none is from the web, the last gives way to the best web row."""
    w = Window.partitionBy("query_id").orderBy(*by_rank())
    web = Window.partitionBy("query_id", "is_web").orderBy(*by_rank())
    r = ranked.withColumns({"_r": F.row_number().over(w), "_w": F.row_number().over(web)}).where(
        (F.col("_r") <= k) | (F.col("is_web") & (F.col("_w") == 1)))
    has = F.max(F.when((F.col("_r") <= k) & F.col("is_web"), 1).otherwise(0)).over(Window.partitionBy("query_id"))
    late = F.max(F.when((F.col("_r") > k) & F.col("is_web"), 1).otherwise(0)).over(Window.partitionBy("query_id"))
    swap = (has == 0) & (late == 1)
    return r.withColumn("_swap", swap).where(
        F.when(F.col("_swap"), (F.col("_r") < k) | (F.col("_r") > k)).otherwise(F.col("_r") <= k)).drop(
        "_r", "_w", "_swap")


def prepend_summaries(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summary chunks lead their query's list at score 1.0; repeated ids keep the summary row."""
    lead = summaries.select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit(0).alias("_b"))
    rest = hits.join(lead.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select(
        "query_id", "chunk_id", "score", F.lit(1).alias("_b"))
    w = Window.partitionBy("query_id").orderBy("_b", *by_rank())
    return lead.unionByName(rest).withColumn("position", F.row_number().over(w).cast("bigint")).drop("_b")


def needs_second_retrieval(best_cross: DataFrame, threshold: float) -> DataFrame:
    """Queries whose best cross-scorer value stays below the relevance threshold (0 disables)."""
    return best_cross.groupBy("query_id").agg(F.max("cross_score").alias("best")).where(
        (F.lit(threshold) > 0) & (F.col("best") < threshold))

"""Scoring and screening of fetched web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import pages as P, queries as Q, scoring as S, text as T, vocab

LOW_VALUE, NO_OVERLAP = "low_value_definition_like", "no_fact_term_overlap"


def query_terms(query: Column) -> Column:
    return T.content_terms(T.search_tokens(F.lower(query)), vocab.WEB_QUERY_STOPWORDS, 2)


def screened(results: DataFrame) -> DataFrame:
    """Rows of ``results`` (query_id, query, position, url, title, snippet) with what screening says of them.

    ``reject_reason`` names the rule a row breaks: a dictionary page that holds fewer than two terms of the
    question, or, where the question asks for a fact, a row that holds none.  ``place`` is the row's place
    among those kept: for a fact by preferred domain, terms and length of the snippet, else as they came.
    A query of which no row is left falls back to all of its rows but the dictionary pages.  Rows without
    a URL are not results.
    """
    blob = F.lower(F.concat_ws(" ", *(T.strip(T.text_or_empty(F.col(c))) for c in ("title", "snippet", "url"))))
    rows = results.withColumns({
        "matches": S.contained(query_terms(F.col("query")), blob).cast("bigint"),
        "preference": P.domain_preference(F.col("url")).cast("bigint"), "_fact": Q.is_external_fact_for_web(F.col("query"))})
    junk = P.low_value_result(F.col("url"), T.text_or_empty(F.col("title"))) & (F.col("matches") < 2)
    given = T.strip(T.text_or_empty(F.col("url"))) != ""
    rows = rows.withColumn("reject_reason", F.when(~given, None).when(junk, LOW_VALUE).when(F.col("_fact") & (F.col("matches") == 0), NO_OVERLAP))
    good = given & F.col("reject_reason").isNull()
    rows = rows.withColumn("_any", F.max(good.cast("int")).over(Window.partitionBy("query_id")) == 1)
    kept = F.when(F.col("_any"), good).otherwise(given & ~F.coalesce(F.col("reject_reason") == LOW_VALUE, F.lit(False)))
    rows = rows.withColumn("_kept", kept)
    ranks = [F.when(F.col("_fact") & F.col("_any"), c) for c in (
        F.col("preference"), F.col("matches"), F.length(T.strip(T.text_or_empty(F.col("snippet")))))]
    order = Window.partitionBy("query_id", "_kept").orderBy(*(F.desc(r) for r in ranks), "position")
    return rows.withColumn("place", F.when(F.col("_kept"), F.row_number().over(order)).cast("bigint")).where(given).drop("_fact", "_any", "_kept")

def web_score(vector_score: Column, lexical: Column) -> Column:
    w = vocab.WEB["vector_weight"]
    return w * vector_score + (1 - w) * lexical


def admit(score: Column, local_top: Column) -> Column:
    """NULL below the relevance floor; capped just under a strong local hit."""
    cap = local_top - vocab.WEB["cap_below_local"]
    capped = F.when(local_top >= vocab.WEB["strong_local"], F.least(score, cap)).otherwise(score)
    return F.when(score >= vocab.WEB["min_relevance"], capped)

"""Topic manifest: keywords per document, topic frequencies, scope of a query, acronyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import text as T, vocab

KEYWORDS_PER_DOC = 40
MAX_TOPICS = 600
MIN_DOC_FREQ = 2
SCOPE_THRESHOLD = 0.20


def topic_tokens(text: Column) -> Column:
    """Lower-cased words of four or more characters outside the topic stop list."""
    return F.filter(T.find_all(F.lower(T.text_or_empty(text)), vocab.TOPIC_TOKEN),
                    lambda t: (F.length(t) >= 4) & ~t.isin(vocab.TOPIC_STOPWORDS))


def document_keywords(chunks: DataFrame, per_doc: int = KEYWORDS_PER_DOC) -> DataFrame:
    """(doc_id, keyword, n, rank): most frequent words per document, ties alphabetical.

    Counts combine map-side per (document, word); the rank limit trims before the
    window shuffle, so a document owning a third of the corpus stays spread out.
    """
    n = chunks.select("doc_id", F.explode(topic_tokens(F.col("text"))).alias("keyword")).groupBy(
        "doc_id", "keyword").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "keyword")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_doc).withColumn(
        "rank", F.col("rank").cast("bigint"))


def topics(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy(F.col("keyword").alias("topic")).agg(F.count("*").alias("df"))


def condense(topic_df: DataFrame, most: int = MAX_TOPICS, min_df: int = MIN_DOC_FREQ) -> DataFrame:
    """Above ``most`` topics keep those in at least ``min_df`` documents, then the ``most`` commonest.

    The cut is a global top-k (TakeOrdered), never a one-partition window.
    """
    total = topic_df.agg(F.count("*")).select(F.col("count(1)")).scalar()
    crowded = topic_df.where((total > most) & (F.col("df") >= min_df)).orderBy(F.desc("df"), "topic").limit(most)
    return topic_df.where(total <= most).unionByName(crowded)


def scope_scores(queries: DataFrame, topic_df: DataFrame, threshold: float = SCOPE_THRESHOLD) -> DataFrame:
    """(query_id, score, in_scope): share of a query's distinct topic words known to the corpus."""
    words = queries.select("query_id", F.explode_outer(F.array_distinct(topic_tokens(F.col("query")))).alias("topic"))
    hit = words.join(topic_df.select("topic", F.lit(1).alias("_known")), "topic", "left")
    score = F.coalesce(F.try_divide(F.count("_known"), F.count("topic")), F.lit(0.0))
    return hit.groupBy("query_id").agg(F.round(score, 6).alias("score"), (score > threshold).alias("in_scope"))


def apply_delta(topic_df: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Topic counts after documents leave and arrive; topics at zero disappear."""
    delta = topic_df.select("topic", "df").unionByName(
        removed.select(F.col("keyword").alias("topic"), F.lit(-1).cast("bigint").alias("df"))).unionByName(
        added.select(F.col("keyword").alias("topic"), F.lit(1).cast("bigint").alias("df")))
    return delta.groupBy("topic").agg(F.sum("df").alias("df")).where("df > 0")


# --- acronyms -------------------------------------------------------------------------
PHRASE_THEN_ACRONYM = r"\b([A-Za-z][A-Za-z\- ]{3,80}?)\s*\(([A-Z]{2,10})\)"
ACRONYM_THEN_PHRASE = r"\b([A-Z]{2,10})\s*\(([A-Za-z][A-Za-z\- ]{3,80}?)\)"


def _mentions(blob: Column, pattern: str, phrase: int, acronym: int) -> Column:
    found = F.arrays_zip(F.regexp_extract_all(blob, F.lit(pattern), F.lit(phrase)).alias("p"),
                         F.regexp_extract_all(blob, F.lit(pattern), F.lit(acronym)).alias("a"))
    return F.transform(found, lambda z: F.struct(F.upper(z["a"]).alias("acronym"),
                                                 T.search_tokens(F.lower(z["p"])).alias("words")))


def mine_acronyms(chunks: DataFrame, best: int = 3) -> DataFrame:
    """(acronym, phrase, n, rank) for 'phrase (ACR)' and 'ACR (phrase)' whose initials fit.

    Mined once per corpus and stored, not once per query.
    """
    blob = F.concat_ws("\n", T.text_or_empty(F.col("title")), T.text_or_empty(F.col("path_text")),
                       T.text_or_empty(F.col("text")))
    m = chunks.select(F.explode(F.concat(_mentions(blob, PHRASE_THEN_ACRONYM, 1, 2),
                                         _mentions(blob, ACRONYM_THEN_PHRASE, 2, 1))).alias("m")).select("m.*")
    ok = (F.size("words") >= 2) & T.acronym_fits(F.col("acronym"), F.col("words"))
    n = m.where(ok).groupBy("acronym", F.array_join("words", " ").alias("phrase")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("acronym").orderBy(F.desc("n"), "phrase")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).withColumn(
        "rank", F.col("rank").cast("bigint"))


def expand_queries(queries: DataFrame, acronyms: DataFrame, per_token: int = 2) -> DataFrame:
    """Append up to ``per_token`` phrases for each upper-case acronym a query uses."""
    tok = T.search_tokens(F.col("query"))
    q = queries.select("query_id", "query", F.array_distinct(T.search_tokens(F.lower("query"))).alias("_have"),
                       F.posexplode_outer(tok).alias("pos", "tok"))
    usable = (F.col("tok").rlike("^[A-Za-z]{2,8}$") & (F.upper("tok") == F.col("tok"))
              & ~F.lower("tok").isin(vocab.QUERY_STOPWORDS))
    hits = q.where(usable).join(acronyms, F.col("tok") == F.col("acronym")).where(
        F.size(F.array_except(F.split("phrase", " "), F.col("_have"))) > 0)
    w = Window.partitionBy("query_id", "pos").orderBy("rank")
    chosen = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_token)
    parts = chosen.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("pos", "_r", "phrase"))), lambda s: s["phrase"]), " ").alias("_more"))
    return queries.join(parts, "query_id", "left").select(
        "query_id", F.concat_ws(" ", "query", "_more").alias("expanded_query"),
        F.col("_more").isNotNull().alias("expanded"))

"""Lexical grounding of answers in retrieved text, sentence by sentence and term by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import citations as Ci, cleaning as C, text as T, vocab

TOP_HITS = 3


def _present(terms: Column, text: Column) -> Column:
    """array<struct<pos, hit>>: which terms (by stem variants) a text contains; the text is lowered once."""
    return T.let(F.lower(T.text_or_empty(text)), lambda low: F.transform(
        terms, lambda t, i: F.struct(i.alias("pos"), T.term_in_text(t, low).alias("hit"))))


def lexical_coverage(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, coverage): share of topic terms found in the best of, or across, the top three hits.

    No or one term gives 1; a short top hit gives 1; two terms need only the longer one.
    """
    q = queries.select("query_id", Ci.stop_terms(F.col("query")).alias("terms"))
    top = hits.where(F.col("rank") <= TOP_HITS).select("query_id", "rank", "text")
    j = q.join(top, "query_id", "left")
    flags = j.withColumn("flags", _present(F.col("terms"), F.col("text")))
    per_hit = flags.groupBy("query_id").agg(
        F.max(F.size(F.filter("flags", lambda f: f["hit"]))).alias("best"),
        F.max(F.size("terms")).alias("n"), F.max(F.when(F.col("rank") == 1, F.length("text"))).alias("top_len"))
    any_hit = flags.select("query_id", F.explode("flags").alias("f")).groupBy("query_id", "f.pos").agg(
        F.max("f.hit").alias("hit"))
    union = any_hit.groupBy("query_id").agg(F.count(F.when(F.col("hit"), 1)).alias("found"))
    # The first of the longest terms decides when there are exactly two.
    longer = F.when(F.length(F.get("terms", F.lit(0))) >= F.length(F.get("terms", F.lit(1))), 0).otherwise(1)
    pick = q.where(F.size("terms") == 2).select("query_id", longer.alias("pos")).join(
        any_hit, ["query_id", "pos"], "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("two"))
    x = per_hit.join(union, "query_id", "left").join(pick, "query_id", "left")
    share = F.greatest(F.col("best"), F.coalesce("found", F.lit(0))) / F.greatest("n", F.lit(1))
    cov = (F.when(F.col("n") <= 1, 1.0).when(F.coalesce("top_len", F.lit(0)) < 40, 1.0)
           .when(F.col("n") == 2, F.col("two").cast("double")).otherwise(share))
    return x.select("query_id", F.round(cov, 6).alias("coverage"))


def sentence_faithfulness(answers: DataFrame, hits: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(query_id, sentence_no, coverage, flagged) for sentences with three or more content terms."""
    body = F.regexp_replace(Ci.strip_citation_block(F.col("answer")), r"\[[^\[\]]{1,20}\]", "")
    s = answers.select("query_id", F.posexplode(C.sentences(body)).alias("sentence_no", "sentence")).withColumn(
        "terms", Ci.stop_terms(F.col("sentence"))).where(F.size("terms") >= 3)
    j = s.join(hits.select("query_id", "text"), "query_id")
    flags = j.select("query_id", "sentence_no", F.explode(_present(F.col("terms"), F.col("text"))).alias("f"))
    seen = flags.groupBy("query_id", "sentence_no", "f.pos").agg(F.max("f.hit").alias("hit"))
    cov = F.count(F.when(F.col("hit"), 1)) / F.count("*")
    return seen.groupBy("query_id", "sentence_no").agg(F.bround(cov, 3).alias("coverage"), (cov < threshold).alias("flagged"))


def unsupported_entities(answers: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, entity) missing from the sources, when three or more and at least 40 % are missing."""
    a = answers.join(queries.select("query_id", T.search_tokens(F.lower("query")).alias("asked")), "query_id").select(
        "query_id", "asked", Ci.entities(Ci.strip_citation_block(F.col("answer"))).alias("ents"))
    total = a.select("query_id", F.size("ents").alias("total"))
    e = a.select("query_id", "asked", F.explode("ents").alias("entity"))
    low = F.lower("entity")
    open_ = e.where(~low.isin(vocab.ENTITY_IGNORE) & ~F.array_contains("asked", low)).select("query_id", "entity")
    src = hits.select("query_id", F.lower("text").alias("text"))
    missing = open_.join(src, "query_id").groupBy("query_id", "entity").agg(
        F.max(F.contains("text", F.lower("entity"))).alias("found")).where(~F.col("found"))
    n = missing.groupBy("query_id").agg(F.count("*").alias("n")).join(total, "query_id")
    bad = n.where((F.col("n") >= 3) & (F.col("n") / F.col("total") >= vocab.COVERAGE_GATES["entity_support"]))
    return missing.join(bad.select("query_id"), "query_id", "left_semi").select("query_id", "entity")


def answer_policy(band: Column, top_score: Column, coverage: Column, intent: Column, metadata_q: Column,
                  has_formula: Column, web_triggered: Column, web_only: Column, web_hits: Column) -> Column:
    """Which gate an answer meets first; 'generate' when none applies."""
    g = vocab.COVERAGE_GATES
    lexical = ~metadata_q & ~intent.isin("formula_lookup", "section_lookup") & (band != "high") & ~web_triggered
    return (F.when(web_only & (web_hits == 0), "internet_no_evidence")
            .when((top_score < g["min_score"]) & ~metadata_q & (intent != "section_lookup"), "low_score")
            .when(lexical & (coverage <= 0) & ~web_only, "zero_lexical_coverage")
            .when(lexical & (coverage < g["min_lexical"]), "low_lexical_coverage")
            .when((intent == "formula_lookup") & ~has_formula, "formula_not_found")
            .when(metadata_q, "extractive_metadata").otherwise("generate"))


def hit_sentences(hits: DataFrame, low: int, high: int) -> DataFrame:
    """(query_id, rank, chunk_id, sent_no, sentence) of admissible length, white space collapsed."""
    flat = F.array_join(T.space_tokens(F.col("text")), " ")
    return hits.select("query_id", "rank", "chunk_id", F.posexplode(C.sentences(flat)).alias("sent_no", "sentence")).where(
        F.length("sentence").between(low, high))


def best_sentences(scored: DataFrame, k: int) -> DataFrame:
    """Top ``k`` distinct sentences per query, ties by hit rank and position."""
    order = [F.desc("score"), F.col("rank"), F.col("sent_no")]
    once = scored.groupBy("query_id", F.lower("sentence").alias("_key")).agg(
        F.min_by(F.struct("score", "rank", "sent_no", "sentence", "chunk_id"),
                 F.struct(-F.col("score"), "rank", "sent_no")).alias("s")).select("query_id", "s.*")
    w = Window.partitionBy("query_id").orderBy(*order)
    return once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).withColumn(
        "position", F.col("position").cast("bigint"))


SUMMARY_IGNORE = ("chapter", "section", "part", "introduction", "summarize", "summary", "overview", "explain", "describe")
STRUCTURE_WORDS = ("introduction", "chapter", "section", "book", "topics", "covers")


def keywords(query: Column, ignore=()) -> Column:
    terms = F.array_distinct(T.search_tokens(F.lower(query)))
    return T.content_terms(terms, sorted(set(vocab.ANSWER_STOPWORDS) | set(ignore)), 2)


def section_summary(queries: DataFrame, hits: DataFrame, k: int = 2) -> DataFrame:
    """Sentences of 45..320 characters scored by keyword hits, structure words and length."""
    q = queries.select("query_id", keywords(F.col("query"), SUMMARY_IGNORE).alias("kw"))
    s = hit_sentences(hits, 45, 320).join(q, "query_id")
    found = T.let(F.lower("sentence"), lambda low: F.size(F.filter("kw", lambda t: T.term_in_text(t, low))))
    score = (found + F.when(T.contains_any(F.lower("sentence"), STRUCTURE_WORDS), 0.5).otherwise(0.0)
             + F.when(T.word_count(F.col("sentence")) >= 12, 0.2).otherwise(0.0))
    return best_sentences(s.withColumn("score", F.round(score, 6)).where("score > 0"), k)


#: Words of a request that do not name its subject.
FACTOID_IGNORE = ("meaning", "explain", "describe", "overview", "summary", "detail", "details")
PUBLICATION_WORDS = ("isbn", "first published", "copyright", "publisher")


def factoid_sentences(queries: DataFrame, hits: DataFrame, k: int = 2) -> DataFrame:
    """Sentences of 30..320 characters scored by term overlap, digits and publication words."""
    q = F.col("query")
    kw = T.let(keywords(q, FACTOID_IGNORE), lambda k: F.when(F.size(k) > 0, k).otherwise(keywords(q)))
    q = queries.select("query_id", kw.alias("kw"), q.rlike(r"\d").alias("digits"))
    s = hit_sentences(hits, 30, 320).join(q, "query_id")
    low = F.lower("sentence")
    overlap = T.let(low, lambda x: F.size(F.filter("kw", lambda t: F.contains(x, t))))
    year = low.rlike(r"\b(19\d{2}|20\d{2})\b") & T.contains_any(low, ("published", "copyright", "edition"))
    has = lambda *w: F.arrays_overlap("kw", T.word_array(w))
    ok = ((~has("isbn") | low.contains("isbn")) & (~has("publisher") | T.contains_any(low, ("published by", "publisher")))
          & (~has("published", "publication", "year", "when") | year))
    scored = s.withColumn("_o", overlap).where(ok & ((F.size("kw") == 0) | (F.col("_o") > 0)))
    score = (F.col("_o") + F.when(F.col("digits") & F.col("sentence").rlike(r"\d"), 1.0).otherwise(0.0)
             + F.when(T.contains_any(low, PUBLICATION_WORDS), 1.0).otherwise(0.0))
    return best_sentences(scored.withColumn("score", F.round(score.cast("double"), 6)), k)


def grounding_counters(answers: DataFrame, cited: DataFrame, stopwords, overlap_floor: float = 0.5) -> DataFrame:
    """Weak sentences, unsupported years and entities, malformed citations per answer.

    ``cited`` holds one lower-cased source text per query.
    """
    stop = list(stopwords)
    j = answers.join(cited.select("query_id", F.lower("source").alias("src")), "query_id")
    parts = F.filter(F.transform(F.split("answer", r"(?<=[.!?])\s+|\n+", -1), T.strip), lambda s: F.length(s) > 0)

    def weak(src: Column):
        def test(s: Column) -> Column:
            toks = F.filter(F.regexp_extract_all(F.lower(s), F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda t: ~t.isin(stop))
            return T.let(toks, lambda ts: (F.size(ts) >= 6) & (
                F.size(F.filter(ts, lambda t: F.contains(src, t))) / F.greatest(F.size(ts), F.lit(1)) < overlap_floor))
        return test

    years = F.regexp_extract_all("answer", F.lit(r"(?U)\b(19\d{2}|20\d{2}|\d{4}s)\b"), F.lit(1))
    ents = F.filter(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"(?U)\b[A-Z][A-Za-z]{2,}\b"), F.lit(0))),
                    lambda t: ~F.lower(t).isin(list(Ci.GROUNDING_NON_ENTITIES)))
    src = F.col("src")
    return j.select(
        "query_id", F.size(F.filter(parts, weak(src))).cast("bigint").alias("weak_sentences"),
        F.size(F.filter(years, lambda y: ~F.contains(src, F.lower(y)))).cast("bigint").alias("unsupported_years"),
        F.size(F.filter(ents, lambda e: ~F.contains(src, F.lower(e)))).cast("bigint").alias("unsupported_entities"),
        Ci.malformed_citations(F.col("answer")).cast("bigint").alias("malformed_citations"))


def grounding_pass(counters: DataFrame, refused: Column) -> DataFrame:
    ok = (F.col("unsupported_years") == 0) & (F.col("malformed_citations") == 0) & (F.col("weak_sentences") <= 1)
    return counters.withColumn("passed", refused | ok)

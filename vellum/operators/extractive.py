"""Answers lifted from hits: passages, section locations, bibliographic fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import citations as Ci, text as T
from vellum.operators import grounding as G

# How bibliographic fields are written.
ISBN = r"(?i)\bISBN(?:-1[03])?\s*[:\-]?\s*([0-9Xx][0-9Xx\-]{9,20})\b"
FIRST_YEAR = r"(?i)First\s+published\s+in\s+(19\d{2}|20\d{2})"
COPYRIGHT_YEAR = r"(?i)Copyright\s*[^\n]{0,120}?\b(19\d{2}|20\d{2})\b"
FIRST_PUBLISHER = r"(?i)First\s+published\s+in\s+\d{4}\s+by\s+([^.\n]+)"
COPYRIGHT_PUBLISHER = r"(?i)Copyright\s*[^\n]{0,40}?\b([A-Z][A-Za-z&., \-]{2,80})\b,\s*\d{4}"
AUTHOR_PAIR = (r"(?i)\bby\s+([A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+)+)\s+and\s+"
               r"([A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+)+)\b")
TITLE_BY = r"\b([A-Z][A-Za-z0-9'’:,\- ]{5,140}?)\s+by\s+[A-Z][A-Za-z.\- ]{3,120}\b"


def field_asked(q: Column) -> Column:
    """author, title, isbn, publisher or year; the first that fits, else NULL."""
    q = F.lower(q)
    return (F.when(q.rlike(r"\bauthors?\b|\bwho\s+wrote\b"), "author").when(q.contains("title"), "title")
            .when(q.contains("isbn"), "isbn")
            .when(q.contains("publisher") | q.rlike(r"\bwho\s+published\b") | (q.contains("published") & q.contains("who")), "publisher")
            .when(q.contains("year") | q.rlike(r"\bwhen\s+was\b"), "year"))


def _field_value(field: Column, blob: Column) -> Column:
    def got(p: str, g: int = 1) -> Column:
        return T.none_if_empty(T.strip(F.regexp_extract(blob, p, g)))

    pair = F.when(got(AUTHOR_PAIR).isNotNull(), F.concat(got(AUTHOR_PAIR, 1), F.lit(" and "), got(AUTHOR_PAIR, 2)))
    publisher = F.regexp_replace(F.coalesce(got(FIRST_PUBLISHER), got(COPYRIGHT_PUBLISHER)), r"\s+\d{1,5}\s.*$|(?i)\s+(?:www\.|https?://).*$", "")
    return (F.when(field == "author", pair).when(field == "title", got(TITLE_BY)).when(field == "isbn", got(ISBN))
            .when(field == "publisher", F.regexp_replace(publisher, r"^[ .,]+|[ .,]+$", ""))
            .when(field == "year", F.coalesce(got(FIRST_YEAR), got(COPYRIGHT_YEAR))))


def metadata_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, field, value, chunk_id): the asked field from the first hit, in rank order, that states it."""
    q = queries.select("query_id", field_asked(F.col("query")).alias("field")).where("field IS NOT NULL")
    blob = F.array_join(T.space_tokens(F.concat_ws(" ", "title", "path_text", "text")), " ")
    v = hits.join(q, "query_id").withColumn("value", _field_value(F.col("field"), blob)).where("value IS NOT NULL")
    first = v.groupBy("query_id").agg(F.min_by(F.struct("value", "chunk_id"), "rank").alias("f"))
    return q.join(first, "query_id", "left").select("query_id", "field", F.col("f.value").alias("value"), F.col("f.chunk_id").alias("chunk_id"))


LOCATOR_IGNORE = ("chapter", "section", "part", "where", "what", "does", "say", "covers", "covered", "discusses", "discussed")
NOISY_PATHS = ("keywords", "index", "references", "bibliography")


def section_locations(queries: DataFrame, hits: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, label, page, score, position): headers matching the query, adjusted by place and path."""
    q = queries.select("query_id", F.lower("query").alias("q"), G.keywords(F.col("query"), LOCATOR_IGNORE).alias("kw"))
    j = hits.join(q, "query_id")
    title, path, page = T.strip(F.col("title")), T.strip(F.col("path_text")), F.col("page_start")
    blob, low = F.lower(F.concat_ws(" ", title, path)), F.lower(path)
    intro = F.col("q").contains("introduction")

    def add(cond: Column, n: float) -> Column:
        return F.when(cond, n).otherwise(0.0)

    overlap = T.let(blob, lambda b: F.size(F.filter("kw", lambda t: F.contains(b, t))))
    person = title.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+)+$") & ~low.contains("chapter")
    here = intro & blob.contains("introduction")
    score = (F.col("_o") + add(low.contains("chapter"), 0.4) + add(low.contains("section") | F.col("q").contains("section"), 0.2)
             + add(here, 0.8) + F.when(here & (page <= 30), 0.6).when(here & (page >= 80), -0.4).otherwise(0.0)
             + F.when(page <= 40, 0.2).when(page >= 120, -0.35).otherwise(0.0)
             + add(T.contains_any(low, NOISY_PATHS), -0.8) + add(title != "", 0.2) + add(person, -0.5))
    ok = (~intro | blob.contains("introduction")) & ((F.col("_o") > 0) | (F.size("kw") == 0))
    label = F.when(title != "", title).otherwise(T.strip(F.element_at(F.split(path, ">"), -1)))
    s = j.withColumn("_o", overlap).where(ok).select("query_id", "rank", label.alias("label"), page.alias("page"), F.round(score, 6).alias("score"))
    once = s.groupBy("query_id", F.lower("label").alias("_k")).agg(F.min_by(F.struct("label", "page", "score", "rank"), F.struct(-F.col("score"), "rank")).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return once.select("query_id", "s.*").withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= k)


def evidence_facts(queries: DataFrame, hits: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, position, fact): sentences of 45..320 characters holding a query keyword, in citation order."""
    q = queries.select("query_id", G.keywords(F.col("query")).alias("kw"))
    s = G.hit_sentences(hits, 45, 320).join(q, "query_id")
    has = T.let(F.lower("sentence"), lambda low: F.exists("kw", lambda t: F.contains(low, t)))
    w = Window.partitionBy("query_id").orderBy("rank", "sent_no")
    out = s.where((F.size("kw") == 0) | has).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
    tag = Ci.short_citation(F.col("chunk_id").cast("string"))
    return out.select("query_id", F.col("position").cast("bigint").alias("position"),
                      F.concat(F.lit("- "), "sentence", F.lit(" ["), tag, F.lit("]")).alias("fact"))


def passage_around(text: Column, term: Column) -> Column:
    """About 80 characters before and 300 after a term, widened to sentence limits, at most 480."""
    flat = F.array_join(T.space_tokens(text), " ")

    def cut(s: Column) -> Column:
        at = F.instr(F.lower(s), term)
        lead = F.substring(s, F.lit(1), F.greatest(at - 80, F.lit(0)))
        start = F.length(F.regexp_extract(lead, r"^(?s)(.*[ .!?])", 1))
        end = F.least(at - 1 + 300, F.length(s))
        tail = F.regexp_extract(F.substring(s, end + 1, F.length(s)), r"^(?s)([^.!?\n]*[.!?\n]?)", 1)
        body = T.strip(F.concat(F.substring(s, start + 1, end - start), tail))
        short = F.concat(F.regexp_replace(F.substring(body, 1, 480), r" [^ ]*$", ""), F.lit("..."))
        return F.when(at == 0, "").when(F.length(body) > 480, short).otherwise(body)

    return T.let(flat, cut)


def best_passages(queries: DataFrame, hits: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, chunk_id, passage): around the longest query term, in the best-ranked of the top hits holding it."""
    q = queries.select("query_id", F.explode(F.array_distinct(Ci.stop_terms(F.col("query")))).alias("term"))
    lead = hits.where(F.col("rank") <= top).select("query_id", "rank", "chunk_id", "text")
    hit = lead.join(q, "query_id").where(F.contains(F.lower("text"), F.col("term")))
    first = hit.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "text", "term"), F.struct(-F.length("term"), "term", "rank")).alias("b"))
    return first.select("query_id", "b.chunk_id", passage_around(F.col("b.text"), F.col("b.term")).alias("passage"))

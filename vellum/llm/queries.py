"""One query per operator over its whole table, and SQL where SQL states the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import (divergence, fertility, filter_audit, license_scan, main_text, mixing_lm, ordinal, packing,
                        simhash, suffix_pieces, threshold_topk, token_counts, warc)
from vellum.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.over_limit(token_counts.token_counts(table(spark, sf_dir, "documents")))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return digest_pieces(packing.pack(table(spark, sf_dir, "documents")))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and fertility verdict of every document."""
    return fertility.quality_rules(table(spark, sf_dir, "documents"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, expected grade and selection of every document."""
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.score(docs, model).withColumn("kept", ordinal.selected())


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and mixed-model score of every document."""
    return mixing_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector."""
    return threshold_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op4_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to."""
    return suffix_pieces.decode_documents(suffix_pieces.encode_documents(table(spark, sf_dir, "documents")))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and find gone already, in every order, for every language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, doc_id, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL
  SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE position(x IN filter_order) = 0),
s AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS earlier
  FROM o, range(1, 6) r(step) WHERE len(filter_order) = 5),
c AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0) AS kept,
         sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS removed,
         sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) <> 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS good_lost,
         sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM c
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language lie apart, and the terms each uses most beyond its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(t, 0) AS t FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS t FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (t + 5 * v) AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
      FROM p JOIN v USING (lang) GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    words, labels = F.transform("base", lambda x: x["word"]), license_scan.labelled
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), F.array_join(labels("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels("base"), labels("hits"))), ",").alias("labels"),
        license_scan.certainty().alias("score"), F.size("hits").cast("long").alias("n_hits"))

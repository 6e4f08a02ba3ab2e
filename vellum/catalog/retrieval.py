"""Lexical and vector search, injection, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import views as V
from vellum.catalog.registry import query, table
from vellum.functions import queries as Q, scoring as S, text as T, vocab
from vellum.operators import containment, lexical, postings, ranking as R, vectors, websearch
from vellum.plans import retrieve
from vellum.session import ensure_checkpoint_dir

TOK = V.tokens_sql
TOP, CAND = 10, 40

# --- shared SQL -------------------------------------------------------------------
BM25_SQL = f"""toks AS (SELECT chunk_id, {TOK("lower(text||' '||title||' '||title||' '||title||' '||title||' '||title||' '||path_text)")} AS tokens FROM corpus),
 st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks),
 dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM toks) GROUP BY term),
 raw AS (SELECT term, ln((n - df + 0.5::DOUBLE)/(df + 0.5::DOUBLE)) AS r FROM dfs, st),
 idf AS (SELECT term, CASE WHEN r < 0 THEN (SELECT avg(r) * 0.25::DOUBLE FROM raw) ELSE r END AS idf FROM raw),
 qt AS (SELECT DISTINCT query_id, unnest({TOK('lower(query)')}) AS term FROM queries),
 tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY 1,2,3),
 bm AS (SELECT query_id, chunk_id, round(sum(idf * (tf*2.5::DOUBLE/(tf + 1.5::DOUBLE*(0.25::DOUBLE + 0.75::DOUBLE*dl/avgdl)))),6) AS bm25
   FROM qt JOIN idf USING (term) JOIN tf USING (term), st GROUP BY 1,2),
 bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm)"""

CENT_SQL = """parts AS (SELECT label, pos, avg(v::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS pos FROM embeddings) GROUP BY 1,2),
 cent AS (SELECT label, list(x ORDER BY pos) AS vector FROM parts GROUP BY label)"""

VEC_SQL = CENT_SQL + f""", sims AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], vector),6) AS score
   FROM queries JOIN cent ON cent.label = query_id % 10, embeddings),
 vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= {2 * CAND})"""

BLOB = "lower(title||' '||path_text||' '||text)"


def _has_sql(words) -> str:
    return f"len(list_intersect({TOK('lower(query)')}, {V.list_sql(words)})) > 0"


KINDS_SQL = f"""kinds AS (SELECT query_id, query, {_has_sql(vocab.METADATA_TERMS)} AS meta,
 len(list_intersect(list_distinct({TOK('lower(query)')}), {V.list_sql(vocab.OVERVIEW_TERMS)})) >= 2 AS overview,
 regexp_matches(query,'[0-9]') OR ({_has_sql(vocab.NUMERIC_TERMS)} AND {_has_sql(vocab.NUMERIC_TRIGGERS)}) AS num,
 list_filter(list_distinct({TOK('lower(query)')}), lambda t: length(t) > 3 AND NOT list_contains({V.list_sql(vocab.QUERY_STOPWORDS)}, t)) AS terms FROM queries)"""

ROLE_SQL = """(CASE WHEN meta THEN CASE structural_role WHEN 'metadata' THEN 0.60 WHEN 'frontmatter' THEN 0.08 WHEN 'toc' THEN 0.25 ELSE -0.20 END
 WHEN overview THEN CASE structural_role WHEN 'frontmatter' THEN 0.12 WHEN 'toc' THEN 0.15 WHEN 'body' THEN CASE WHEN page_start > 30 THEN -0.06 ELSE 0 END ELSE 0 END
 ELSE CASE structural_role WHEN 'metadata' THEN -0.12 WHEN 'toc' THEN -0.30 WHEN 'frontmatter' THEN CASE WHEN page_start <= 20 THEN -0.04 ELSE 0 END ELSE 0 END END)::DOUBLE
 + CASE WHEN token_count_est > 0 AND token_count_est < 20 THEN -0.20 ELSE 0 END::DOUBLE"""

ADJ_SQL = KINDS_SQL + f""", adj AS (SELECT vec.query_id, vec.chunk_id, round(vec.score + {ROLE_SQL} +
   least(0.015::DOUBLE * len(list_filter(terms, lambda t: contains({BLOB}, t))), 0.10::DOUBLE),6) AS score
   FROM vec JOIN kinds USING (query_id) JOIN corpus USING (chunk_id)),
 cand AS (SELECT query_id, chunk_id, score, 'vector' AS lane FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM adj) WHERE r <= {CAND})"""

INJ_SQL = f"""inj AS (SELECT query_id, chunk_id, 0.0::DOUBLE AS score, 'bm25' AS lane FROM (
   SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank, b.chunk_id) AS r FROM bmr b
   WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id=b.query_id AND c.chunk_id=b.chunk_id)) WHERE r <= {TOP}),
 pool AS (SELECT * FROM cand UNION ALL SELECT * FROM inj)"""

RERANK_SQL = f"""rr0 AS (SELECT p.query_id, p.chunk_id, p.lane, p.score AS vector_score, c.structural_role, c.source_type, c.doc_id, c.token_count_est, c.text, c.title, c.path_text, q.query,
   {TOK('lower(q.query)')} AS qt0, {TOK('lower(c.text)')} AS tt0,
   list_distinct({TOK("lower(c.title||' '||c.path_text)")}) AS hs FROM pool p JOIN queries q USING (query_id) JOIN corpus c USING (chunk_id)),
 rr1 AS (SELECT *, list_distinct(qt0) AS qs, list_distinct(tt0) AS ts, len(list_intersect(list_distinct(qt0), list_distinct(tt0)))::DOUBLE AS ix FROM rr0),
 rr AS (SELECT *, round(0.68::DOUBLE*vector_score + 0.24::DOUBLE*(CASE WHEN len(qs)+len(ts)=0 THEN 1 ELSE ix/(len(qs)+len(ts)-ix) END)
   + least(0.25::DOUBLE, 0.05::DOUBLE*ix) + least(0.24::DOUBLE, 0.06::DOUBLE*len(list_intersect(qs,hs)))
   + CASE WHEN len(qs)>=2 AND contains(array_to_string(tt0,' '), array_to_string(qt0,' ')) THEN 0.14 ELSE 0 END::DOUBLE
   - CASE WHEN token_count_est > 0 AND token_count_est < 20 THEN 0.15 ELSE 0 END::DOUBLE, 6) AS score FROM rr1)"""

BROAD_SQL = "'" + Q.BROAD_REQUEST.replace("'", "''") + "'"
BASE = f"WITH {V.CORPUS_SQL}, {V.QUERIES_SQL}, "
HYBRID = BASE + ", ".join([BM25_SQL, VEC_SQL, ADJ_SQL, INJ_SQL, RERANK_SQL])


# --- shared Spark --------------------------------------------------------------------
def vector_rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def query_vectors(spark, sf):
    cent = vectors.centroids(table(spark, sf, "embeddings"), "label").withColumnRenamed("query_id", "label")
    q = V.benchmark_queries(spark, sf).withColumn("label", (F.col("query_id") % 10).cast("int"))
    return q.join(cent, "label").select("query_id", "vector")


def vector_hits(spark, sf, k=2 * CAND):
    return vectors.top_k(vector_rows(spark, sf), query_vectors(spark, sf), k)


def candidates(spark, sf):
    q, rows = V.benchmark_queries(spark, sf), V.corpus(spark, sf)
    adj = R.adjust(vector_hits(spark, sf), q, rows)
    return R.cut(adj, CAND).select("query_id", "chunk_id", "score", F.lit("vector").alias("lane"))


def term_index(spark, sf):
    """The stored index of the corpus; the first query that asks for it builds it."""
    return postings.stored(V.corpus(spark, sf), ensure_checkpoint_dir(spark), "corpus")


def bm25_ranked(spark, sf, k):
    terms = lexical.query_terms(V.benchmark_queries(spark, sf), "query")
    return postings.search(term_index(spark, sf), terms, k).select("query_id", "chunk_id", "bm25", "rank")


def pool(spark, sf):
    return R.inject(candidates(spark, sf), bm25_ranked(spark, sf, CAND + TOP), TOP, "bm25")


def reranked(spark, sf):
    return R.rerank(pool(spark, sf), V.benchmark_queries(spark, sf), V.corpus(spark, sf))


# --- lexical ------------------------------------------------------------------------
@query("bm25_top_documents", "RK-1 RK-2 SO-3", BASE + BM25_SQL + " SELECT query_id, chunk_id, bm25, rank::BIGINT AS rank FROM bmr WHERE rank <= 10")
def _(spark, sf):
    return bm25_ranked(spark, sf, 10)


TERMS_SQL = f"""WITH t AS (SELECT unnest(list_distinct({TOK("lower(text||' '||regexp_extract(text, '^[A-Za-z]+')||' '||lang||' > '||source)")})) AS term FROM documents),
 d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
 r AS (SELECT term, df, ln(((SELECT count(*) FROM documents) - df + 0.5::DOUBLE)/(df + 0.5::DOUBLE)) AS r FROM d)
SELECT term, df, round(CASE WHEN r < 0 THEN (SELECT avg(r) * 0.25::DOUBLE FROM r) ELSE r END,6) AS idf FROM r"""


@query("bm25_term_statistics", "RK-1", TERMS_SQL)
def _(spark, sf):
    return term_index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


# --- vectors ------------------------------------------------------------------------
@query("vector_top_k", "SO-1 FN-8", f"WITH {CENT_SQL}, s AS (SELECT c.label::BIGINT AS query_id, vec_id AS chunk_id, "
       "round(list_cosine_similarity(embedding::DOUBLE[], vector),6) AS score FROM cent c, embeddings), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM s) SELECT * FROM r WHERE rank <= 25")
def _(spark, sf):
    cent = vectors.centroids(table(spark, sf, "embeddings"), "label")
    return vectors.top_k(vector_rows(spark, sf), cent, 25).withColumn("query_id", F.col("query_id").cast("bigint"))


@query("two_vector_blend", "SO-2", f"WITH {CENT_SQL}, s AS (SELECT c.label::BIGINT AS query_id, vec_id AS chunk_id, "
       "round(0.6::DOUBLE*list_cosine_similarity(embedding::DOUBLE[], c.vector) + 0.4::DOUBLE*list_cosine_similarity(embedding::DOUBLE[], d.vector),6) AS score "
       "FROM cent c JOIN cent d ON d.label = (c.label + 1) % 10, embeddings), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM s) SELECT * FROM r WHERE rank <= 25")
def _(spark, sf):
    cent = vectors.centroids(table(spark, sf, "embeddings"), "label")
    second = cent.select(((F.col("query_id") + 9) % 10).alias("query_id"), F.col("vector").alias("second"))
    return vectors.top_k(vector_rows(spark, sf), cent.join(second, "query_id"), 25, blend=0.6).withColumn(
        "query_id", F.col("query_id").cast("bigint"))


@query("label_cosine_to_centroid", "FN-8 FN-9", f"WITH {CENT_SQL} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], vector),6) AS similarity, "
       "round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])),6) AS length FROM embeddings JOIN cent USING (label)")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    cent = vectors.centroids(e, "label").withColumnRenamed("query_id", "label")
    v = F.col("embedding")
    return e.join(cent, "label").select("vec_id", F.round(vectors.cosine(v, F.col("vector")), 6).alias("similarity"),
                                        F.round(vectors.norm(v), 6).alias("length"))


# --- candidates and injection -----------------------------------------------------------
@query("adjusted_vector_candidates", "RK-4 SO-4 JN-9 FN-22 FN-23 JN-15", BASE + VEC_SQL + ", " + ADJ_SQL + " SELECT query_id, chunk_id, score, lane FROM cand")
def _(spark, sf):
    return candidates(spark, sf)


@query("bm25_injection", "RK-3 JN-10 SE-4", BASE + ", ".join([BM25_SQL, VEC_SQL, ADJ_SQL, INJ_SQL]) + " SELECT * FROM pool")
def _(spark, sf):
    return pool(spark, sf)


@query("step_back_injection", "RK-5 JN-10", BASE + VEC_SQL + ", " + ADJ_SQL + f""", sb AS (SELECT query_id, vec_id AS chunk_id,
 round(list_cosine_similarity(embedding::DOUBLE[], vector),6) AS s FROM queries JOIN cent ON cent.label = (query_id+1) % 10, embeddings),
 sbr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM sb),
 inj AS (SELECT query_id, chunk_id, 0.0::DOUBLE AS score, 'step_back' AS lane FROM (SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY rank) AS r FROM sbr b
  WHERE rank <= {CAND + TOP} AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id=b.query_id AND c.chunk_id=b.chunk_id)) WHERE r <= {TOP})
SELECT * FROM cand UNION ALL SELECT * FROM inj""")
def _(spark, sf):
    cent = vectors.centroids(table(spark, sf, "embeddings"), "label").withColumnRenamed("query_id", "label")
    q = V.benchmark_queries(spark, sf).withColumn("label", ((F.col("query_id") + 1) % 10).cast("int"))
    broader = vectors.top_k(vector_rows(spark, sf), q.join(cent, "label").select("query_id", "vector"), CAND + TOP)
    return R.inject(candidates(spark, sf), broader, TOP, "step_back")


@query("feedback_terms", "RK-6 AG-19", BASE + VEC_SQL + ", " + ADJ_SQL + f""", lead AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM cand) WHERE r <= 3),
 w AS (SELECT query_id, unnest({TOK('lower(text)')}) AS term FROM lead JOIN corpus USING (chunk_id)),
 f AS (SELECT query_id, term, count(*) AS n FROM w WHERE length(term) >= 4 AND term NOT IN {V.in_sql(R.FEEDBACK_STOPWORDS)} GROUP BY 1,2),
 qt AS (SELECT DISTINCT query_id, unnest({TOK('lower(query)')}) AS term FROM queries),
 g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term)::BIGINT AS rank FROM f WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id=f.query_id AND qt.term=f.term))
SELECT query_id, term, rank FROM g WHERE rank <= 5""")
def _(spark, sf):
    return R.feedback_terms(candidates(spark, sf), V.benchmark_queries(spark, sf), V.corpus(spark, sf))


@query("feedback_injection", "RK-6")
def _(spark, sf):
    q, rows = V.benchmark_queries(spark, sf), V.corpus(spark, sf)
    cand = candidates(spark, sf)
    terms = lexical.query_terms(q, "query").unionByName(
        R.feedback_terms(cand, q, rows).select("query_id", "term"))
    return R.inject(cand, postings.search(term_index(spark, sf), terms, CAND + TOP), TOP, "feedback")


@query("question_search", "AG-10 RK-7 JN-5", f"""WITH {CENT_SQL}, s AS (SELECT c.label::BIGINT AS query_id, e.label::BIGINT AS chunk_id, e.vec_id AS question_id,
 round(list_cosine_similarity(embedding::DOUBLE[], vector),6) AS score FROM cent c, embeddings e),
 b AS (SELECT query_id, chunk_id, max(score) AS score, arg_max(question_id, (score, -question_id))::BIGINT AS question_id FROM s GROUP BY 1,2)
SELECT query_id, chunk_id, question_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM b) WHERE r <= 5""")
def _(spark, sf):
    from vellum.operators.questions import best_question_per_chunk
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"),
                                              F.col("label").cast("bigint").alias("chunk_id"), "embedding")
    cent = vectors.centroids(table(spark, sf, "embeddings"), "label")
    return best_question_per_chunk(e, cent, 5).withColumn("query_id", F.col("query_id").cast("bigint"))


# --- reranking ------------------------------------------------------------------------------
@query("hybrid_retrieval", "RK-3 RK-4 RK-8 SC-1 SO-3", HYBRID + f""" SELECT query_id, chunk_id, lane, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM rr) WHERE rank <= {TOP}""")
def _(spark, sf):
    return lexical.top_k(reranked(spark, sf).select("query_id", "chunk_id", "lane", "score"), TOP, "score")


@query("rerank_by_query", "RK-8", HYBRID + " SELECT query_id, chunk_id, vector_score, score FROM rr")
def _(spark, sf):
    return reranked(spark, sf).select("query_id", "chunk_id", "vector_score", "score")


@query("rerank_by_preference", "RK-10", HYBRID + """ SELECT query_id, chunk_id, round(score + CASE WHEN contains(text,'|') THEN 0.03 ELSE 0 END::DOUBLE
 + CASE WHEN token_count_est > 0 AND token_count_est < 250 THEN 0.02 ELSE 0 END::DOUBLE, 6) AS score FROM rr""")
def _(spark, sf):
    r = reranked(spark, sf)
    s = S.preference_score(F.col("score"), F.col("has_table"), F.col("token_count_est"), True, True)
    return r.select("query_id", "chunk_id", F.round(s, 6).alias("score"))


@query("novelty_order", "RK-9")
def _(spark, sf):
    return R.novelty_order(R.cut(reranked(spark, sf), CAND + TOP), max_select=TOP)


LOGIT_SQL = "(token_count_est % 17 - 8)::DOUBLE / 4"


@query("cross_score_blend", "RK-11 FN-11", HYBRID + f""", p AS (SELECT *, structural_role='toc' AS toc, row_number() OVER (PARTITION BY query_id, structural_role='toc' ORDER BY score DESC, chunk_id) AS r FROM rr),
 b AS (SELECT query_id, chunk_id, CASE WHEN NOT toc AND r <= 24 THEN 0 WHEN toc THEN 1 ELSE 2 END AS bucket,
  round(CASE WHEN NOT toc AND r <= 24 THEN 0.75::DOUBLE*score + 0.25::DOUBLE/(1+exp(-({LOGIT_SQL}))) ELSE score END,6) AS score FROM p)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY bucket, score DESC, chunk_id)::BIGINT AS position FROM b""")
def _(spark, sf):
    logit = ((F.col("token_count_est") % 17) - 8) / 4.0
    return R.apply_cross_scores(reranked(spark, sf), logit).select("query_id", "chunk_id", "score", "position")


@query("rank_fusion", "RK-12 AG-13 WN-2", BASE + BM25_SQL + ", " + VEC_SQL + """, l AS (
 SELECT query_id, 'bm25' AS list_id, chunk_id, rank, bm25 AS score FROM bmr WHERE rank <= 50
 UNION ALL SELECT query_id, 'vector', chunk_id, rank, score FROM vec WHERE rank <= 50)
SELECT query_id, chunk_id, round(sum(1.0::DOUBLE/(60+rank)),6) AS rrf_score, CASE WHEN arg_min(score,(rank,list_id))=0 THEN round(sum(1.0::DOUBLE/(60+rank)),6) ELSE arg_min(score,(rank,list_id)) END AS score FROM l GROUP BY 1,2""")
def _(spark, sf):
    a = bm25_ranked(spark, sf, 50).select("query_id", F.lit("bm25").alias("list_id"), "chunk_id", "rank",
                                          F.col("bm25").alias("score"))
    b = vector_hits(spark, sf, 50).select("query_id", F.lit("vector").alias("list_id"), "chunk_id", "rank", "score")
    return R.reciprocal_rank_fusion(a.unionByName(b))


@query("score_gaps_and_confidence", "WN-3 RK-14 RK-29", HYBRID + f""", g AS (SELECT query_id, max(score) FILTER (WHERE r=1) AS top_score,
 COALESCE(round(max(score) FILTER (WHERE r=1) - max(score) FILTER (WHERE r=2),6), 1.0) AS score_gap, max(structural_role) FILTER (WHERE r=1) AS role, max(query) FILTER (WHERE r=1) AS query,
 max(title||' '||path_text) FILTER (WHERE r=1) AS header FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM rr) GROUP BY 1),
 h AS (SELECT *, len(list_intersect({TOK('lower(query)')}, {TOK('lower(header)')})) >= 1 AS header_match, regexp_matches(query, {BROAD_SQL}) AND score_gap < 0.06 AS thin FROM g)
SELECT query_id, top_score, score_gap, (score_gap < 0.03 OR top_score < 0.55) AS low_confidence, header_match,
 CASE WHEN top_score < 0.55 THEN 'low' WHEN top_score < 0.70 THEN 'medium' WHEN role IN ('index_noise','frontmatter') AND NOT {_has_sql(vocab.METADATA_FACT_HINTS)} THEN 'medium'
  WHEN header_match THEN 'high' WHEN thin THEN 'medium' ELSE 'high' END AS band FROM h""")
def _(spark, sf):
    r = reranked(spark, sf)
    g = R.score_gaps(r, carry=("structural_role", "query", "title", "path_text"))
    match = S.header_match(F.col("query"), F.col("title"), F.col("path_text"))
    return g.select("query_id", "top_score", "score_gap",
                    S.low_confidence(F.col("top_score"), F.col("score_gap")).alias("low_confidence"), match.alias("header_match"),
                    S.confidence_band(F.col("top_score"), F.col("score_gap"), F.col("structural_role"), F.col("query"), match).alias("band"))


SECOND_TYPE, SECOND_K = "de", 2


@query("typed_second_pass", "RK-16 SO-10", HYBRID + f""", top AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM rr) WHERE r <= {TOP}),
 dv AS (SELECT query_id, chunk_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sims s JOIN corpus c USING (chunk_id) WHERE c.source_type='{SECOND_TYPE}') WHERE r <= {3 * SECOND_K}),
 da AS (SELECT dv.query_id, dv.chunk_id, round(dv.score + {ROLE_SQL} + least(0.015::DOUBLE * len(list_filter(terms, lambda t: contains({BLOB}, t))), 0.10::DOUBLE),6) AS score FROM dv JOIN kinds USING (query_id) JOIN corpus USING (chunk_id)),
 di AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.query_id ORDER BY d.score DESC, d.chunk_id) AS r FROM da d WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id=d.query_id AND t.chunk_id=d.chunk_id)) WHERE r <= {SECOND_K}),
 un AS (SELECT query_id, chunk_id, score, FALSE AS boosted FROM top UNION ALL SELECT query_id, chunk_id, score, TRUE FROM di),
 cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, score DESC, chunk_id) AS r FROM un) WHERE r <= {TOP})
SELECT query_id, chunk_id, score, boosted, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS position FROM cl""")
def _(spark, sf):
    q, rows = V.benchmark_queries(spark, sf), V.corpus(spark, sf)
    hits = R.cut(reranked(spark, sf).select("query_id", "chunk_id", "score"), TOP)
    own = rows.where(F.col("source_type") == SECOND_TYPE)
    found = vectors.top_k(vector_rows(spark, sf).join(own.select("chunk_id"), "chunk_id", "left_semi"), query_vectors(spark, sf), 3 * SECOND_K)
    return R.second_pass(hits, R.adjust(found, q, own), SECOND_K, TOP)


@query("clamp_keeping_boosted", "SO-10", HYBRID + f""" SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (lane='bm25') DESC, score DESC, chunk_id) AS r FROM rr) WHERE r <= {TOP + 5}""")
def _(spark, sf):
    return R.clamp_keeping(reranked(spark, sf), TOP + 5, F.col("lane") == "bm25").select("query_id", "chunk_id", "score")


@query("prepend_summaries", "RK-18", HYBRID + """, s AS (SELECT query_id, chunk_id FROM rr WHERE structural_role='metadata')
SELECT query_id, chunk_id, CASE WHEN b=0 THEN 1.0::DOUBLE ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY b, CASE WHEN b=0 THEN 1.0::DOUBLE ELSE score END DESC, chunk_id)::BIGINT AS position
FROM (SELECT *, CASE WHEN structural_role='metadata' THEN 0 ELSE 1 END AS b FROM rr)""")
def _(spark, sf):
    r = reranked(spark, sf)
    return R.prepend_summaries(r.select("query_id", "chunk_id", "score"),
                               r.where("structural_role = 'metadata'").select("query_id", "chunk_id"))


@query("second_retrieval_trigger", "RK-19", HYBRID + f""" SELECT query_id, round(max(1/(1+exp(-({LOGIT_SQL})))),6) AS best FROM rr GROUP BY 1 HAVING max(1/(1+exp(-({LOGIT_SQL})))) < 0.88""")
def _(spark, sf):
    logit = ((F.col("token_count_est") % 17) - 8) / 4.0
    c = reranked(spark, sf).withColumn("cross_score", S.sigmoid(logit))
    return R.needs_second_retrieval(c, 0.88).select("query_id", F.round("best", 6).alias("best"))


WEB_SQL = """web AS (SELECT query_id, chunk_id, CASE WHEN w >= 0.42 THEN round(CASE WHEN lt >= 0.62 THEN least(w, lt - 0.02::DOUBLE) ELSE w END,6) END AS score FROM (
 SELECT query_id, chunk_id, lt, round(0.72::DOUBLE*abs(sin(chunk_id)) + 0.28::DOUBLE*vector_score,6) AS w FROM rr JOIN (SELECT query_id, max(score) AS lt FROM rr GROUP BY 1) USING (query_id) WHERE source_type='fr'))"""


def _web_and_local(spark, sf):
    r = reranked(spark, sf)
    top = R.score_gaps(r).select("query_id", F.col("top_score").alias("lt"))
    w = F.round(websearch.web_score(F.abs(F.sin("chunk_id")), F.col("vector_score")), 6)
    web = r.where("source_type = 'fr'").join(top, "query_id").select(
        "query_id", "chunk_id", F.round(websearch.admit(w, F.col("lt")), 6).alias("score"))
    return r.select("query_id", "chunk_id", "score"), web


@query("web_result_scores", "RK-15", HYBRID + ", " + WEB_SQL + " SELECT query_id, chunk_id, round(score,6) AS score FROM web")
def _(spark, sf):
    return _web_and_local(spark, sf)[1]


@query("merge_local_and_web", "SE-1 SE-5", HYBRID + ", " + WEB_SQL + """, u AS (SELECT query_id, chunk_id, score, FALSE AS is_web FROM rr UNION ALL SELECT query_id, chunk_id, round(score,6), TRUE FROM web WHERE score IS NOT NULL),
 d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, is_web) AS r FROM u) WHERE r = 1)
SELECT query_id, chunk_id, score, is_web, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_web DESC, score DESC, chunk_id)::BIGINT AS position FROM d) WHERE position <= 10""")
def _(spark, sf):
    local, web = _web_and_local(spark, sf)
    return R.merge_local_and_web(local, web.where("score IS NOT NULL"), 10)


@query("force_one_web_row", "SE-6", HYBRID + """, d AS (SELECT query_id, chunk_id, score, source_type='es' AS is_web FROM rr),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r, row_number() OVER (PARTITION BY query_id, is_web ORDER BY score DESC, chunk_id) AS w FROM d),
 f AS (SELECT *, max((r<=5 AND is_web)::INT) OVER (PARTITION BY query_id) AS has, max(is_web::INT) OVER (PARTITION BY query_id) AS any_web FROM n)
SELECT query_id, chunk_id, score, is_web FROM f WHERE CASE WHEN has=0 AND any_web=1 THEN r < 5 OR (is_web AND w=1) ELSE r <= 5 END""")
def _(spark, sf):
    d = reranked(spark, sf).select("query_id", "chunk_id", "score", (F.col("source_type") == "es").alias("is_web"))
    return R.force_one_web_row(d, 5)


@query("lexical_candidates", "FN-24 JN-15", BASE + f"""a AS (SELECT query_id, list_filter({TOK('lower(query)')}, lambda t: length(t)>2 AND NOT list_contains({V.list_sql(vocab.QUERY_STOPWORDS)},t)) AS terms FROM queries),
 w AS (SELECT query_id, len(list_distinct(terms)) AS n, unnest(terms) AS term FROM a),
 v AS (SELECT query_id, n, term, count(*) AS weight FROM w GROUP BY ALL),
 b AS (SELECT chunk_id, {BLOB} AS blob FROM corpus)
SELECT query_id, chunk_id, round(sum(weight)::DOUBLE/n,6) AS score FROM v JOIN b ON contains(blob, term) GROUP BY query_id, chunk_id, n""")
def _(spark, sf):
    """Every benchmark query against every chunk; pairs without a common term have score 0 and are left out."""
    q = V.benchmark_queries(spark, sf).select("query_id", T.content_terms(
        T.search_tokens(F.lower("query")), vocab.QUERY_STOPWORDS, 2).alias("terms"))
    asked = q.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    rows = V.corpus(spark, sf).select("chunk_id", S.header_blob(F.col("title"), F.col("path_text"), F.col("text")).alias("blob"))
    found = containment.matches(rows, asked, "chunk_id", "blob")
    sizes = q.select("query_id", F.size(F.array_distinct("terms")).alias("n"))
    return found.join(sizes, "query_id").select("query_id", "chunk_id", F.round(F.col("matches") / F.col("n"), 6).alias("score"))


# --- query understanding ------------------------------------------------------------------------
PREFIX = ("who was NASA chief in 2020 ", "what is this book about ", "explain the overview of chapters and topics ",
          "what has Acme released today ", "compute the formula for ", "When did Paris ", "tell us the latest ", "isbn and publisher of ")


def asked(spark, sf):
    t = table(spark, sf, "conversations")
    n = F.lit(len(PREFIX))
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(
        F.element_at(T.word_array(PREFIX), (F.pmod(F.col("conv_id") + F.col("turn"), n) + 1).cast("int")),
        F.lower("text")).alias("query"))


ASKED_SQL = f"asked AS (SELECT conv_id::VARCHAR||'-'||turn::VARCHAR AS qid, {V.list_sql(PREFIX)}[((conv_id+turn) % {len(PREFIX)}) + 1]||lower(text) AS query FROM conversations)"
_LT, _TK = TOK("lower(query)"), TOK("query")
_h = lambda words: f"len(list_intersect(lt, {V.list_sql(words)})) > 0"
_UP = "upper(t)=t AND regexp_matches(t,'[A-Z]')"


@query("query_kinds", "FN-21", f"""WITH {ASKED_SQL}, k AS (SELECT qid, query, {_LT} AS lt, {_TK} AS tk FROM asked),
 f AS (SELECT *, lt[1] AS op, regexp_matches(query,'\\b(?:19|20)\\d{{2}}\\b') AS yr, len(list_filter(tk, lambda t: {_UP}))>0 AS ent,
  len(list_filter(tk[2:], lambda t: regexp_matches(t,'^[A-Z]') AND NOT ({_UP})))>0 AS pn, {_h(vocab.RECENCY_TERMS)} AS rec, {_h(vocab.NEWS_TERMS)} AS news,
  {_h(vocab.RELEASE_VERBS)} AS rel, {_h(vocab.STRONG_RECENCY_TERMS)} AS srec, {_h(vocab.BIOGRAPHICAL_TERMS)} AS bio,
  {_h(vocab.WEB_RECENCY_TERMS)} AS wrec, {_h(vocab.WEB_NEWS_TERMS)} AS wnews FROM k)
SELECT qid, {_h(vocab.METADATA_TERMS)} AS is_metadata, regexp_matches(query,'[0-9]') OR ({_h(vocab.NUMERIC_TERMS)} AND {_h(vocab.NUMERIC_TRIGGERS)}) AS is_numeric,
 CASE WHEN op IN {V.in_sql(vocab.FACT_OPENERS)} THEN yr OR ent OR pn OR rec WHEN op='what' THEN srec OR news OR (pn AND rel) WHEN op IN {V.in_sql(vocab.INFORMATIONAL_OPENERS)} THEN rec OR news ELSE news END AS external_fact,
 CASE WHEN op IN {V.in_sql(vocab.FACT_OPENERS)} THEN yr OR ent OR pn OR wrec OR bio WHEN op='what' THEN wrec OR wnews OR bio OR yr OR (pn AND rel) WHEN op IN {V.in_sql(vocab.INFORMATIONAL_OPENERS)} THEN wrec OR wnews ELSE wnews END AS external_fact_web,
 op IN {V.in_sql(vocab.COVERAGE_FACT_OPENERS)} AND (yr OR list_contains(lt,'current') OR len(list_filter(tk[2:], lambda t: ({_UP}) OR (regexp_matches(t,'^[A-Z]') AND length(t)>=3 AND NOT list_contains({V.list_sql(vocab.ANSWER_STOPWORDS)},lower(t)))))>0) AS external_fact_coverage,
 regexp_matches(query,'(?i){"|".join(Q.OVERVIEW_PHRASES)}') AS overview_request, len(list_intersect(list_distinct(lt),{V.list_sql(vocab.OVERVIEW_TERMS)}))>=2 AS overview_terms,
 (op IN {V.in_sql(vocab.FACTOID_OPENERS)} AND len(lt)<=14) OR {_h(vocab.FACTOID_HINTS)} OR (len(lt)<=8 AND query LIKE '%?') AS factoid,
 {_h(vocab.METADATA_FACT_HINTS)} AS metadata_fact FROM f""")
def _(spark, sf):
    q = F.col("query")
    return asked(spark, sf).select(
        "qid", Q.is_metadata(q).alias("is_metadata"), Q.is_numeric(q).alias("is_numeric"),
        Q.is_external_fact(q).alias("external_fact"), Q.is_external_fact_for_web(q).alias("external_fact_web"),
        Q.is_external_fact_for_coverage(q).alias("external_fact_coverage"),
        Q.is_overview_request(q).alias("overview_request"), Q.is_overview_terms(q).alias("overview_terms"),
        Q.is_factoid(q).alias("factoid"), Q.is_metadata_fact(q).alias("metadata_fact"))


COMPARE = ("compare the {a} and {b}?", "{a} vs. {b}", "what is the difference between {a} and {b}?",
           "how does {a} differ from {b}?", "describe how {a} and {b}", "tell me of {a}")


def _compare_sql() -> str:
    out = "CASE item_id % 6 "
    for i, c in enumerate(COMPARE):
        lit = c.replace("{a}", "'||a||'").replace("{b}", "'||b||'")
        out += f"WHEN {i} THEN '{lit}' "
    return out + "END"


def _topic_case() -> str:
    out = "CASE "
    for i, (p, groups) in enumerate(Q.SUB_TOPIC_PATTERNS):
        arr = "[" + ",".join(f"regexp_extract(query,'{p}',{g})" for g in groups) + "]"
        clean = (f"list_filter(list_transform({arr}, lambda s: trim(regexp_replace(regexp_replace(trim(s),'[?.!,;]+$',''),'(?i)^(?:the|a|an)\\s+',''))), "
                 f"lambda s: length(s)>=2 AND NOT list_contains({V.list_sql(Q.VAGUE_FRAGMENTS)},lower(s)))")
        out += f"WHEN len({clean})>=2 THEN {clean}[:3] "
    return out + "ELSE [] END"


_OPENER = "regexp_extract(query,'(?i)^(what\\s+is|what\\s+are|how\\s+does|how\\s+do|explain|describe|define)\\b')"
SUBS_SQL = f"""s AS (SELECT *, {_topic_case()} AS topics FROM q),
 u AS (SELECT *, unnest(topics) AS topic, generate_subscripts(topics,1)-1 AS list_id FROM s WHERE len(topics) > 0),
 o AS (SELECT *, CASE WHEN {_OPENER}='' THEN 'what is' ELSE {_OPENER} END AS opener, list_filter(topics, lambda t: lower(t) <> lower(topic))[1] AS sib FROM u),
 subs AS (SELECT *, CASE WHEN len(string_split(topic,' '))>6 THEN topic WHEN len(topics)=2 AND sib IS NOT NULL AND len(string_split(sib,' '))<=4 THEN opener||' '||topic||' versus '||sib ELSE opener||' '||topic END AS sub_query FROM o)"""


def _questions(d):
    """``query`` comparing the topics ``a`` and ``b``, in one of the phrasings."""
    expr = F
    for i, c in enumerate(COMPARE):
        parts = [F.col(x[1]) if x in ("{a}", "{b}") else F.lit(x) for x in _pieces(c)]
        expr = expr.when(F.col("item_id") % 6 == i, F.concat(*parts))
    return d.withColumn("query", expr)


@query("sub_topics_and_sub_queries", "FN-46", f"""WITH w AS (SELECT item_id, regexp_extract_all(text,'[A-Za-z]+') AS w FROM benchmark),
 c AS (SELECT item_id, pair, w[2*pair+1] AS a, w[2*pair+2] AS b FROM w, unnest(range(len(w)//2)) r(pair)), q AS (SELECT item_id, pair, {_compare_sql()} AS query FROM c), {SUBS_SQL}
SELECT item_id, pair, query, topic, sub_query FROM subs""")
def _(spark, sf):
    """Questions about every pair of neighbouring words of every benchmark text."""
    w = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 2).cast("int") - 1), lambda i: F.struct(
        i.cast("long").alias("pair"), F.get("w", 2 * i).alias("a"), F.get("w", 2 * i + 1).alias("b")))
    d = w.where(F.size("w") > 1).select("item_id", F.inline(pairs))
    q = _questions(d).withColumn("topics", Q.sub_topics(F.col("query")))
    return q.select("item_id", "pair", "query", "topics", F.explode("topics").alias("topic")).select(
        "item_id", "pair", "query", "topic", Q.sub_query(F.col("query"), F.col("topic"), F.col("topics")).alias("sub_query"))


@query("decomposed_retrieval", "RK-13 RK-12", f"""WITH {V.CORPUS_SQL}, h AS (SELECT item_id, regexp_extract_all(text,'[A-Za-z]+') AS w FROM benchmark),
 c AS (SELECT item_id, array_to_string(w[:len(w)//2],' ') AS a, array_to_string(w[len(w)//2+1:],' ') AS b FROM h), q AS (SELECT item_id, {_compare_sql()} AS query FROM c), {SUBS_SQL},
 queries AS (SELECT item_id::VARCHAR||'/'||list_id::VARCHAR AS query_id, sub_query AS query FROM subs), {BM25_SQL},
 f AS (SELECT item_id AS query_id, chunk_id, round(sum(1.0::DOUBLE/(60+rank)),6) AS rrf_score, arg_min(bm25,(rank,list_id)) AS score
   FROM bmr JOIN subs ON bmr.query_id = item_id::VARCHAR||'/'||list_id::VARCHAR WHERE rank <= 10 GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id)::BIGINT AS position FROM f)
SELECT query_id, chunk_id, rrf_score, CASE WHEN score=0 THEN rrf_score ELSE score END AS score, position FROM r WHERE position <= 10""")
def _(spark, sf):
    """Comparisons of the two halves of every benchmark text, answered topic by topic and fused."""
    w = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    d = w.select("item_id", F.array_join(F.slice("w", 1, half), " ").alias("a"), F.array_join(F.slice("w", half + 1, F.size("w")), " ").alias("b"))
    index = term_index(spark, sf)
    search = lambda q: postings.search(index, lexical.query_terms(q, "query"), TOP).withColumnRenamed("bm25", "score")
    return retrieve.decomposed(_questions(d).select(F.col("item_id").alias("query_id"), "query"), search, TOP)


def _pieces(template: str) -> list[str]:
    import re
    return [p for p in re.split(r"(\{[ab]\})", template) if p]

"""Evaluation metrics over label relevance, events and retrieval runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import answers as An, retrieval as Rt
from vellum.catalog.registry import query, table
from vellum.operators import metrics as M, vectors

K = 10
CASE_SQL = f"""WITH {Rt.CENT_SQL}, cases AS (SELECT label::VARCHAR AS case_id, 10::BIGINT AS top_k, CASE WHEN label%3=0 THEN 'summary' ELSE 'fact_lookup' END AS intent FROM cent),
 s AS (SELECT c.label::VARCHAR AS case_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], vector),6) AS score FROM cent c, embeddings),
 ret AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {K}),
 rel AS (SELECT label::VARCHAR AS case_id, vec_id AS chunk_id, (vec_id % 3)::INT AS gain FROM embeddings),
 h AS (SELECT r.*, rel.gain, (rel.gain IS NOT NULL)::INT AS hit, sum((rel.gain IS NOT NULL)::INT) OVER (PARTITION BY r.case_id ORDER BY rank) AS seen FROM ret r LEFT JOIN rel ON rel.case_id=r.case_id AND rel.chunk_id=r.chunk_id),
 g AS (SELECT case_id, count(*) AS n, sum(hit) AS hits, sum(hit) FILTER (WHERE rank<=1) AS h1, sum(hit) FILTER (WHERE rank<=3) AS h3, sum(hit) FILTER (WHERE rank<=5) AS h5, min(rank) FILTER (WHERE hit=1) AS fr,
  sum(CASE WHEN hit=1 THEN 1.0::DOUBLE/log2(rank+1) ELSE 0 END) AS dcg, sum(COALESCE(gain,0)/log2(rank+1)) AS gdcg, sum(CASE WHEN hit=1 THEN seen::DOUBLE/rank ELSE 0 END) AS ap FROM h GROUP BY 1),
 e AS (SELECT case_id, count(*)::BIGINT AS expected FROM rel GROUP BY 1),
 gi AS (SELECT case_id, sum(gain/log2(i+1)) AS gideal FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY gain DESC, chunk_id) AS i FROM rel) WHERE i <= {K} GROUP BY 1),
 m AS (SELECT c.case_id, intent, expected, hits::DOUBLE/expected AS recall, h1::DOUBLE/expected AS recall_1, h3::DOUBLE/expected AS recall_3, h5::DOUBLE/expected AS recall_5, hits::DOUBLE/n AS precision, COALESCE(1.0::DOUBLE/fr,0) AS mrr,
  dcg/(SELECT sum(1.0::DOUBLE/log2(i+1)) FROM range(1, least(expected,{K})+1) t(i)) AS ndcg, gdcg/gideal AS graded_ndcg, ap/expected AS average_precision FROM cases c JOIN e USING (case_id) JOIN g USING (case_id) JOIN gi USING (case_id))"""


def case_metrics(spark, sf):
    e = table(spark, sf, "embeddings")
    cent = vectors.centroids(e, "label")
    ret = vectors.top_k(Rt.vector_rows(spark, sf), cent, K).select(
        F.col("query_id").cast("string").alias("case_id"), "rank", "chunk_id")
    lab = F.col("label")
    cases = e.select(lab).distinct().select(
        lab.cast("string").alias("case_id"), F.lit(K).cast("bigint").alias("top_k"),
        F.when(lab % 3 == 0, "summary").otherwise("fact_lookup").alias("intent"))
    rel = e.select(lab.cast("string").alias("case_id"), F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 3).cast("int").alias("gain"))
    return M.per_case(cases, ret, rel)


NAMES = ("recall", "recall_1", "recall_3", "recall_5", "precision", "mrr", "ndcg", "graded_ndcg", "average_precision")


@query("retrieval_metrics", "EV-1 EV-2 EV-3 EV-4 EV-5 EV-6 WN-4", CASE_SQL + " SELECT case_id, expected, " + ", ".join(f"round({n},6) AS {n}" for n in NAMES) + " FROM m")
def _(spark, sf):
    return case_metrics(spark, sf).select("case_id", "expected", *[F.round(n, 6).alias(n) for n in NAMES])


_AGG = "count(*)::BIGINT AS cases, " + ", ".join(f"round(avg({m}),4) AS mean_{m}" for m in M.METRICS)


@query("metrics_by_intent", "EV-7 AG-14", CASE_SQL + f" SELECT intent, {_AGG} FROM m GROUP BY intent")
def _(spark, sf):
    return M.aggregate(case_metrics(spark, sf), "intent")


@query("metric_deltas", "EV-8", CASE_SQL + """ SELECT case_id, round(precision*0.9+0.05,6) AS old_value, round(precision,6) AS new_value, round(round(precision,6)-round(precision*0.9+0.05,6),6) AS delta,
 CASE WHEN round(round(precision,6)-round(precision*0.9+0.05,6),6) < -0.005 THEN 'regression' WHEN round(round(precision,6)-round(precision*0.9+0.05,6),6) > 0.005 THEN 'improved' ELSE 'same' END AS verdict FROM m""")
def _(spark, sf):
    cur = case_metrics(spark, sf).select("case_id", F.round("precision", 6).alias("v"), F.round(F.col("precision") * 0.9 + 0.05, 6).alias("w"))
    return M.deltas(cur.select("case_id", "v"), cur.select("case_id", F.col("w").alias("v")), "case_id", "v")


@query("latency_quantiles", "EV-10", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 q AS (SELECT event_type, max(n)::BIGINT AS n, max(value) AS mx, max(value) FILTER (WHERE rn=floor((n+1)*19/20.0::DOUBLE)) AS a, max(value) FILTER (WHERE rn=floor((n+1)*19/20.0::DOUBLE)+1) AS b, max((n+1)*19/20.0::DOUBLE - floor((n+1)*19/20.0::DOUBLE)) AS w FROM r GROUP BY 1)
SELECT q.event_type, n, round(m.p50,6) AS p50, round(CASE WHEN n>=20 THEN a*(1-w)+COALESCE(b,0)*w ELSE mx END,6) AS p95 FROM q JOIN (SELECT event_type, median(value) AS p50 FROM events GROUP BY 1) m USING (event_type)""")
def _(spark, sf):
    return M.latency_quantiles(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id")


@query("pass_rates_by_config", "AG-15 AG-16 EV-11 EV-12", """WITH r AS (SELECT (user_id % 6)::BIGINT AS config, event_type AS axis, value > 15 AS passed FROM events)
SELECT config, count(*)::BIGINT AS n_total, sum(passed::INT)::BIGINT AS n_pass, round(sum(passed::INT)::DOUBLE/count(*),3) AS pass_rate,
 """ + ", ".join(f"round(COALESCE(sum(passed::INT) FILTER (WHERE axis='{a}')::DOUBLE/NULLIF(count(*) FILTER (WHERE axis='{a}'),0),0),3) AS rate_{a}" for a in ("view", "click", "error")) + " FROM r GROUP BY 1")
def _(spark, sf):
    r = table(spark, sf, "events").select((F.col("user_id") % 6).alias("config"), F.col("event_type").alias("axis"), (F.col("value") > 15).alias("passed"))
    return M.pass_rates(r, "config", "axis", ("view", "click", "error"))


@query("grid_of_thresholds", "AG-17 EV-12", """WITH t AS (SELECT a*1.0::DOUBLE AS cut, b FROM (VALUES (5),(15),(25)) x(a), (VALUES (1.0::DOUBLE),(0.5::DOUBLE)) y(b))
SELECT cut*b AS threshold, count(*) FILTER (WHERE value > cut*b)::BIGINT AS accepted, count(*) FILTER (WHERE (value > cut*b) = (event_type='purchase'))::BIGINT AS correct FROM events, t GROUP BY 1""")
def _(spark, sf):
    cuts = [p["cut"] * p["scale"] for p in M.parameter_grid({"cut": (5.0, 15.0, 25.0), "scale": (1.0, 0.5)})]
    return M.threshold_sweep(table(spark, sf, "events"), "value", F.col("event_type") == "purchase", cuts)


@query("baseline_comparison", "EV-14", """WITH b AS (SELECT event_type||(user_id%8)::VARCHAR AS category, sum((value>15)::INT) AS p, count(*) AS n FROM events WHERE event_id%2=0 AND user_id%8<>7 GROUP BY 1),
 c AS (SELECT event_type||(user_id%8)::VARCHAR AS category, sum((value>14)::INT) AS p, count(*) AS n FROM events WHERE event_id%2=CASE WHEN user_id%8=1 THEN 1 ELSE 0 END AND user_id%8<>3 GROUP BY 1)
SELECT COALESCE(b.category,c.category) AS category, CASE WHEN b.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'gone' WHEN b.n<>c.n THEN 'not_comparable' WHEN abs(c.p::DOUBLE/c.n-b.p::DOUBLE/b.n)<0.001 THEN 'unchanged' WHEN c.p::DOUBLE/c.n>b.p::DOUBLE/b.n THEN 'improvement' ELSE 'regression' END AS status,
 CASE WHEN b.n=c.n THEN round(c.p::DOUBLE/c.n-b.p::DOUBLE/b.n,6) END AS delta FROM b FULL JOIN c USING (category)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    u = F.col("user_id") % 8

    def run(cut, keep):
        return e.where(keep).groupBy(F.concat("event_type", u.cast("string")).alias("category")).agg(
            F.sum((F.col("value") > cut).cast("int")).alias("passed"), F.count("*").alias("n"))

    return M.compare_to_baseline(run(15, (F.col("event_id") % 2 == 0) & (u != 7)),
                                 run(14, (F.col("event_id") % 2 == F.when(u == 1, 1).otherwise(0)) & (u != 3)))


@query("acceptance_checks", "EV-15 AG-20", An.HITS_SQL + """, d AS (SELECT query_id, count(DISTINCT doc_id)::BIGINT AS sources FROM hits WHERE rank<=5 GROUP BY 1),
 c AS (SELECT query_id, sources, sources>=5 AS div, CASE query_id%3 WHEN 0 THEN 'summary' WHEN 1 THEN 'formula_lookup' ELSE 'fact_lookup' END AS actual, CASE query_id%4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['comparison'] ELSE ['metadata_lookup'] END AS exp FROM d)
SELECT query_id, sources, array_to_string(list_filter([CASE WHEN NOT div THEN 'minimum_source_diversity_met' END, CASE WHEN NOT (len(exp)=0 OR list_contains(exp,actual) OR (actual IN ('summary','fact_lookup') AND list_contains(exp,'comparison'))) THEN 'intent_matches_expectation' END], lambda x: x IS NOT NULL),',') AS failed FROM c""")
def _(spark, sf):
    d = M.source_diversity(An.hits(spark, sf), 5, 5)
    q = F.col("query_id")
    actual = F.when(q % 3 == 0, "summary").when(q % 3 == 1, "formula_lookup").otherwise("fact_lookup")
    exp = F.when(q % 4 == 0, F.array().cast("array<string>")).when(q % 4 == 1, F.array(F.lit("comparison"))).otherwise(F.array(F.lit("metadata_lookup")))
    checks = {"minimum_source_diversity_met": F.col("diverse"), "intent_matches_expectation": M.intent_matches(actual, exp)}
    return d.select("query_id", "sources", F.array_join(M.failed_checks(checks), ",").alias("failed"))


@query("merged_cases", "EV-16", """SELECT doc_id::VARCHAR AS case_id, 'stored' AS origin FROM labels UNION ALL SELECT doc_id::VARCHAR, 'seeded' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    s = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("stored").alias("origin"))
    n = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("seeded").alias("origin"))
    return M.merge_cases(s, n)



"""Routing, planning, document scope, registry, extractive answers, embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import answers as An, retrieval as Rt, views as V
from vellum.catalog.registry import query, table
from vellum.functions import embedder, pages, text as T, windows
from vellum.operators import extractive as Ex, operations as O, routing as Ro, vectors

VOTE_SQL = f"""WITH {Rt.CENT_SQL}, sim AS (SELECT e.vec_id AS query_id, c.label::VARCHAR AS label, round(list_cosine_similarity(embedding::DOUBLE[],vector),6) AS similarity FROM embeddings e, cent c),
 v AS (SELECT query_id, label, CASE WHEN max(similarity) OVER (PARTITION BY query_id) > 0 THEN similarity/max(similarity) OVER (PARTITION BY query_id) ELSE similarity END AS vote FROM sim)"""


def _sims(spark, sf):
    """Similarity of every vector to every label's centroid."""
    rows = table(spark, sf, "embeddings")
    found = vectors.all_scores(rows, vectors.centroids(rows, "label"), "vec_id")
    return found.select(F.col("vec_id").alias("query_id"), F.col("query_id").cast("string").alias("label"), F.col("score").alias("similarity"))


@query("example_votes", "RK-27", VOTE_SQL + " SELECT query_id, label, round(vote,6) AS vote FROM v")
def _(spark, sf):
    return Ro.example_votes(_sims(spark, sf)).withColumn("vote", F.round("vote", 6))


@query("blended_intents", "RK-27 UD-4", VOTE_SQL + """, b AS (SELECT query_id, label, round(0.6::DOUBLE*((query_id*7+label::INT*3)%10)/10.0 + 0.4::DOUBLE*vote,6) AS blended FROM v),
 z AS (SELECT query_id, label, ((query_id*7+label::INT*3)%10)/10.0::DOUBLE AS score FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS r FROM z),
 zz AS (SELECT query_id, max(label) FILTER (WHERE r=1) AS l1, max(score) FILTER (WHERE r=1) AS s1, max(label) FILTER (WHERE r=2) AS l2, max(score) FILTER (WHERE r=2) AS s2 FROM r GROUP BY 1)
SELECT b.query_id, max(blended) AS blended, arg_min(label,(-blended,label)) AS label, max(CASE WHEN s1>=0.65 THEN l1 END) AS primary_label, max(CASE WHEN round(s1-s2,9)<=0.15 THEN l2 END) AS secondary_label FROM b JOIN zz USING (query_id) GROUP BY 1""")
def _(spark, sf):
    s = _sims(spark, sf)
    nli = s.select("query_id", "label", (((F.col("query_id") * 7 + F.col("label").cast("int") * 3) % 10) / 10.0).alias("score"))
    return Ro.blended_intent(Ro.example_votes(s), nli).join(Ro.zero_shot(nli), "query_id").select(
        "query_id", "blended", "label", F.col("primary").alias("primary_label"), F.col("secondary").alias("secondary_label"))


INTENT_SQL = "CASE turn%5 WHEN 0 THEN 'fact_lookup' WHEN 1 THEN 'current_data_lookup' WHEN 2 THEN 'conversational' WHEN 3 THEN 'user_profile' ELSE 'exploratory' END"
HEADS = ("check the report ", "hello", "what do my files say of ", "tell me ")
CUES_SQL = " + ".join(f"regexp_matches(query,'{p}')::INT" for p in Ro.DOC_CUES)


@query("source_plan_scores", "RK-28 AG-21", f"""WITH a AS (SELECT conv_id::VARCHAR||'-'||turn::VARCHAR AS qid, CASE WHEN conv_id%4=1 THEN 'hello' ELSE {V.list_sql(HEADS)}[(conv_id%4)+1]||text END AS query, {INTENT_SQL} AS intent, turn%2=1 AS needs_web, conv_id%3=0 AS coll, conv_id%5=0 AS docf, (turn%4)::BIGINT AS rr, (conv_id%3)::BIGINT AS wr FROM conversations),
 b AS (SELECT *, ({CUES_SQL})>0 AS cues, regexp_matches(query,'{Ro.SMALL_TALK}') AS talk FROM a)
SELECT qid, (coll::INT*4 + docf::INT*5 + cues::INT*4 + CASE WHEN rr>0 THEN least(4,rr+1) ELSE 0 END + (intent IN {V.in_sql(Ro.FACTUAL_INTENTS)} AND (coll OR docf OR cues OR rr>0))::INT*2)::BIGINT AS rag,
 (CASE WHEN wr>0 AND needs_web THEN least(4,wr+1) ELSE 0 END + needs_web::INT*6 + (intent='current_data_lookup')::INT*3)::BIGINT AS web,
 (cues::INT*-4 + needs_web::INT*-3 + CASE WHEN intent IN ('conversational_meta','user_profile') THEN 6 WHEN intent='conversational' THEN 4 ELSE 0 END + talk::INT*4)::BIGINT AS chat,
 needs_web AND NOT cues AS web_first, CASE intent WHEN 'fact_lookup' THEN 10 WHEN 'exploratory' THEN 10 ELSE 5 END::BIGINT AS top_k FROM b""")
def _(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    head = F.element_at(T.word_array(HEADS), (c % 4 + 1).cast("int"))
    intent = (F.when(t % 5 == 0, "fact_lookup").when(t % 5 == 1, "current_data_lookup").when(t % 5 == 2, "conversational")
              .when(t % 5 == 3, "user_profile").otherwise("exploratory"))
    steps = F.array_repeat(F.lit("rag"), (t % 4).cast("int"))
    a = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"), F.when(c % 4 == 1, "hello").otherwise(F.concat(head, "text")).alias("query"),
        intent.alias("intent"), (t % 2 == 1).alias("nw"), (c % 3 == 0).alias("coll"), (c % 5 == 0).alias("docf"),
        O.source_momentum(steps, "rag").alias("rr"), (c % 3).cast("int").alias("wr"))
    s = Ro.source_scores(F.col("query"), F.col("intent"), F.col("nw"), F.col("coll"), F.col("docf"), F.col("rr"), F.col("wr"))
    k, _c = Ro.strategy(F.col("intent"))
    return a.select("qid", *[v.cast("bigint").alias(n) for n, v in s.items()], Ro.web_first(F.col("query"), F.col("nw")).alias("web_first"),
                    k.cast("bigint").alias("top_k"))


TITLE_SQL = f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(p_name,'[A-Z][a-z]+|[A-Z]+$|[a-z]+'), lambda w: length(w)>1), lambda w: lower(w)), lambda w: NOT list_contains({V.list_sql(Ro.TITLE_STOPWORDS)},w)))"


@query("scoped_documents", "JN-16 FN-47", f"""WITH t AS (SELECT p_partkey AS doc_id, unnest({TITLE_SQL}) AS word FROM part),
 q AS (SELECT s_suppkey AS query_id, list_distinct(list_filter(regexp_extract_all(lower(p_name),'[a-z]+'), lambda w: length(w)>1 AND NOT list_contains({V.list_sql(Ro.TITLE_STOPWORDS)},w))) AS ws FROM supplier JOIN part ON p_partkey=s_suppkey),
 w AS (SELECT query_id, len(ws) AS n, unnest(ws) AS word FROM q WHERE len(ws)>=2), h AS (SELECT query_id, doc_id, count(*)::DOUBLE/max(n) AS score FROM w JOIN t USING (word) GROUP BY 1,2 HAVING count(*)::DOUBLE/max(n)>=0.5)
SELECT query_id, doc_id, round(score,6) AS score FROM h WHERE score >= (SELECT max(score) FROM h g WHERE g.query_id=h.query_id) - 0.1 - 1e-12""")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    q = table(spark, sf, "supplier").join(part, F.col("s_suppkey") == F.col("doc_id")).select(
        F.col("s_suppkey").alias("query_id"), F.concat(F.lit("According to "), "title", F.lit(" book, what holds?")).alias("query"))
    return Ro.scoped_documents(q, part).withColumn("score", F.round("score", 6))


@query("registry_entries", "FN-48", """WITH f AS (SELECT p_partkey, p_brand||' - '||p_name||CASE p_partkey%3 WHEN 0 THEN ' (2011, Acme Press)' WHEN 1 THEN ' (1999)' ELSE '' END||CASE WHEN p_partkey%2=0 THEN ' - libgen.li' ELSE '' END||'.pdf' AS fn, CASE WHEN p_partkey%5=0 THEN '{"title": "Own", "author": ""}' END AS meta, p_brand, p_name FROM part)
SELECT p_partkey, CASE WHEN meta IS NOT NULL THEN 'Own' ELSE p_name END AS title, p_brand AS authors, CASE WHEN p_partkey%3=0 THEN 'Acme Press' END AS publisher, CASE p_partkey%3 WHEN 0 THEN '2011' WHEN 1 THEN '1999' END AS year FROM f""")
def _(spark, sf):
    k = F.col("p_partkey")
    fn = F.concat("p_brand", F.lit(" - "), "p_name", F.when(k % 3 == 0, " (2011, Acme Press)").when(k % 3 == 1, " (1999)").otherwise(""),
                  F.when(k % 2 == 0, " - libgen.li").otherwise(""), F.lit(".pdf"))
    p = table(spark, sf, "part").select("p_partkey", fn.alias("fn"), F.when(k % 5 == 0, '{"title": "Own", "author": ""}').alias("meta"))
    return p.select("p_partkey", *[v.alias(n) for n, v in Ro.registry_entry(F.col("fn"), F.col("meta")).items()])


# --- extractive answers ----------------------------------------------------------------
FIELDS = ("who wrote it", "what is the title", "give the isbn", "who published this", "when was it made")
IMPRINT = " Deep Rivers by Ann Lee and Bob Ray. ISBN: 0-12-345678-9. First published in 2003 by Acme Press 12 X."


@query("metadata_field_answers", "RK-35d", An.HITS_SQL + f""", q AS (SELECT query_id, ['author','title','isbn','publisher','year'][(query_id%5)+1] AS field FROM ask), h AS (SELECT query_id, min(rank) AS r FROM hits WHERE chunk_id%2=0 GROUP BY 1)
SELECT q.query_id, field, CASE WHEN h.r IS NOT NULL THEN CASE field WHEN 'author' THEN 'Ann Lee and Bob Ray' WHEN 'title' THEN 'Deep Rivers' WHEN 'isbn' THEN '0-12-345678-9' WHEN 'publisher' THEN 'Acme Press' ELSE '2003' END END AS value, hits.chunk_id FROM q LEFT JOIN h USING (query_id) LEFT JOIN hits ON hits.query_id=q.query_id AND hits.rank=h.r""")
def _(spark, sf):
    h = An.hits(spark, sf).select("query_id", "rank", "chunk_id", F.lit("").alias("title"), F.lit("").alias("path_text"),
                                  F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("# " + IMPRINT.strip() + " "), F.regexp_replace("text", "(?i)by", "at"))).otherwise("none").alias("text"))
    q = An.asks(spark, sf).select("query_id", F.element_at(T.word_array(FIELDS), (F.col("query_id") % 5 + 1).cast("int")).alias("query"))
    return Ex.metadata_answers(q, h)


@query("evidence_facts", "RK-35a", An.HITS_SQL + f""", kw AS (SELECT query_id, list_filter(list_distinct({V.tokens_sql('lower(query)')}), lambda t: length(t)>2 AND NOT list_contains({An.KWSTOP},t)) AS kw FROM ask), {An.hit_sent_sql(45, 320)},
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, sent_no)::BIGINT AS position FROM hs JOIN kw USING (query_id) WHERE len(kw)=0 OR len(list_filter(kw, lambda t: contains(lower(sentence),t)))>0)
SELECT query_id, position, '- '||sentence||' ['||right(chunk_id::VARCHAR,12)||']' AS fact FROM f WHERE position<=6""")
def _(spark, sf):
    return Ex.evidence_facts(An.asks(spark, sf), An.hits(spark, sf))


@query("best_passages", "RK-35a")
def _(spark, sf):
    return Ex.best_passages(An.asks(spark, sf), An.hits(spark, sf))


@query("section_locations", "RK-35c", An.HITS_SQL + f""", kw AS (SELECT query_id, lower(query) AS q, list_filter(list_distinct({V.tokens_sql('lower(query)')}), lambda t: length(t)>2 AND NOT list_contains({An.KWSTOP},t) AND NOT list_contains({V.list_sql(Ex.LOCATOR_IGNORE)},t)) AS kw FROM (SELECT query_id, 'which section on fr and '||query AS query FROM ask)),
 c AS (SELECT *, trim(title) AS tt, lower(trim(title)||' '||trim(path_text)) AS blob FROM hits JOIN kw USING (query_id)), o AS (SELECT *, len(list_filter(kw, lambda t: contains(blob,t))) AS ov FROM c),
 s AS (SELECT query_id, rank, CASE WHEN tt<>'' THEN tt ELSE trim(list_extract(string_split(path_text,'>'),-1)) END AS label, page_start AS page, round(ov + 0.2::DOUBLE + CASE WHEN page_start<=40 THEN 0.2 WHEN page_start>=120 THEN -0.35 ELSE 0 END::DOUBLE
  + CASE WHEN {' OR '.join(f"contains(lower(path_text),'{n}')" for n in Ex.NOISY_PATHS)} THEN -0.8 ELSE 0 END::DOUBLE + CASE WHEN tt<>'' THEN 0.2 ELSE 0 END::DOUBLE,6) AS score FROM o WHERE ov>0),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(label) ORDER BY score DESC, rank) AS r FROM s) WHERE r=1),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::BIGINT AS position FROM u)
SELECT query_id, label, page::BIGINT AS page, score, position FROM p WHERE position<=2""")
def _(spark, sf):
    q = An.asks(spark, sf).withColumn("query", F.concat(F.lit("which section on fr and "), "query"))
    return Ex.section_locations(q, An.hits(spark, sf)).select("query_id", "label", F.col("page").cast("bigint").alias("page"), "score", "position")


# --- embedding and sequential text helpers ------------------------------------------------
@query("hash_embeddings", "UD-1 UD-2 FN-9")
def _(spark, sf):
    v = embedder.hash_embedding(F.col("text"), 64)
    d = table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return d.select("doc_id", F.round(vectors.norm(F.col("v")), 6).alias("length"), F.array_join(F.transform(
        "v", lambda x: F.round(x, 6).cast("string")), ",").alias("vector"))


@query("embedded_text_search", "UD-2 SO-1 RK-4")
def _(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), embedder.hash_embedding(F.col("text"), 128).alias("embedding"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), embedder.hash_embedding(F.col("text"), 128).alias("vector"))
    return vectors.top_k(chunks, q, 10)


@query("page_windows", "FN-42")
def _(spark, sf):
    d = table(spark, sf, "pages").select("page_id", pages.visible_text(F.col("html")).alias("text"))
    return d.select("page_id", F.posexplode(windows.overlapping_windows(F.col("text"))).alias("idx", "part"))


TABLES = ((), (". ", "\n| a | b |\n|---|:-:|\n| 1 | 2 |\n|  | x y |\nend\n"))


@query("compact_tables", "FN-38", """WITH t AS (SELECT doc_id, replace(replace(text,'|','/'),'. ', chr(10)||'| a | b |'||chr(10)||'|---|:-:|'||chr(10)||'| 1 | 2 |'||chr(10)||'|  | x y |'||chr(10)||'end'||chr(10)) AS t FROM documents),
 r AS (SELECT doc_id, replace(t, '| a | b |'||chr(10)||'|---|:-:|'||chr(10)||'| 1 | 2 |'||chr(10)||'|  | x y |', 'Table rows:'||chr(10)||'- a: 1; b: 2'||chr(10)||'- b: x y') AS t FROM t)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t,chr(10)), lambda l: """ + V.strip_sql("l") + """), lambda l: l<>''), chr(10)) AS text FROM r""")
def _(spark, sf):
    t = F.replace(F.replace(F.col("text"), F.lit("|"), F.lit("/")), F.lit(". "), F.lit(TABLES[1][1]))
    return table(spark, sf, "documents").select("doc_id", windows.compact_tables(t).alias("text"))


@query("page_classes", "SQ-17", """SELECT event_id, CASE WHEN value/200.0::DOUBLE > 0.15 THEN 'table_heavy' WHEN (user_id<80 AND event_id%40>=20) OR (event_id%40>=15 AND user_id>0 AND (event_id%40)::DOUBLE/user_id>0.08) THEN 'math_heavy' WHEN user_id=0 THEN 'standard'
 WHEN (event_id%9)::DOUBLE/user_id>0.05 THEN 'math_heavy' WHEN (event_id%90)::DOUBLE/user_id>0.40 THEN 'code_heavy' ELSE 'standard' END AS page_class FROM events""")
def _(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select("event_id", windows.page_class(F.col("value") / 200.0, u, e % 9, e % 90, e % 40).alias("page_class"))



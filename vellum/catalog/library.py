"""Catalogue queries: documents, chunks, collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import views as V
from vellum.catalog.registry import query
from vellum.functions import text as T
from vellum.operators import library as L
from vellum.operators.filters import RetrievalFilters, compile_filters
from vellum.operators.questions import replace_questions

W = V.LIBRARY_SQL


@query("filtered_chunk_scan", "SC-1 JN-1 PR-2 PR-3 PR-4 PR-5", W + """
SELECT c.chunk_id, c.doc_id, c.structural_role, c.page_start::BIGINT AS page_start, d.filename
FROM chunks c LEFT JOIN docs d USING (doc_id)
WHERE c.path_text LIKE '%>_F%' AND (c.page_end IS NULL OR c.page_end >= 40)
  AND (c.page_start IS NULL OR c.page_start <= 250) AND NOT c.has_table
  AND c.source_type = 'pdf_book' AND c.structural_role = 'body'""")
def _(spark, sf):
    f = RetrievalFilters(path_prefix="%>_F", page_min=40, page_max=250, has_table=False,
                         source_type="pdf_book", structural_role="body")
    docs = V.library_docs(spark, sf).select("doc_id", "filename")
    chunks = V.library_chunks(spark, sf).drop("filename")
    return compile_filters(chunks, f).join(docs, "doc_id", "left").select(
        "chunk_id", "doc_id", "structural_role", F.col("page_start").cast("bigint").alias("page_start"),
        "filename")


@query("chunks_of_named_documents", "SC-5 PR-1", W + """
SELECT chunk_id, doc_id FROM chunks WHERE doc_id IN ('d1','d4','d7','d10','d13')""")
def _(spark, sf):
    f = RetrievalFilters(doc_id="d2", doc_ids=("d1", "d4", "d7", "d10", "d13"))  # the list outranks the single id
    return compile_filters(V.library_chunks(spark, sf), f).select("chunk_id", "doc_id")


@query("document_by_key", "SC-2", W + """
SELECT doc_id, filename, source_type, collection_id FROM docs WHERE doc_id = 'd7'""")
def _(spark, sf):
    return compile_filters(V.library_docs(spark, sf), RetrievalFilters(doc_id="d7")).select(
        "doc_id", "filename", "source_type", "collection_id")


@query("replaced_questions", "SC-20", """WITH inc AS (
 SELECT conv_id AS chunk_id, max(text) AS t FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 6 <> 0 GROUP BY 1)
SELECT conv_id AS chunk_id, text AS question, turn::DOUBLE AS first FROM conversations WHERE conv_id NOT IN (SELECT chunk_id FROM inc)
UNION ALL SELECT chunk_id, 'what is '||t, 1.0::DOUBLE FROM inc UNION ALL SELECT chunk_id, 'why '||t, 2.0::DOUBLE FROM inc""")
def _(spark, sf):
    c = V.table(spark, sf, "conversations")
    stored = c.select(F.col("conv_id").alias("chunk_id"), F.col("text").alias("question"),
                      F.array(F.col("turn").cast("double")).alias("embedding"))
    new = c.where("conv_id % 3 = 0").groupBy(F.col("conv_id").alias("chunk_id")).agg(F.max("text").alias("t"))
    asked = F.array(F.concat(F.lit("what is "), "t"), F.concat(F.lit("why "), "t"))
    new = new.select("chunk_id", F.when(F.col("chunk_id") % 6 != 0, asked).alias("questions"),
                     F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))).alias("embeddings"))
    return replace_questions(stored, new).select("chunk_id", "question", F.col("embedding")[0].alias("first"))


@query("collection_scope_scan", "PR-6 JN-8", W + """, scope AS (
SELECT collection_id FROM collections WHERE collection_id='r1' OR parent_id='r1')
SELECT collection_id, count(*)::BIGINT AS chunk_count, count(DISTINCT doc_id)::BIGINT AS doc_count
FROM chunks WHERE collection_id IN (SELECT collection_id FROM scope) GROUP BY 1""")
def _(spark, sf):
    f = RetrievalFilters(collection_id="r1")
    hit = compile_filters(V.library_chunks(spark, sf), f, collections=V.library_collections(spark, sf))
    per = hit.groupBy("collection_id", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("collection_id").agg(F.sum("n").alias("chunk_count"),
                                            F.count("doc_id").alias("doc_count"))


@query("extraction_corpus_scan", "SC-3 JN-2", W + """
SELECT c.chunk_id, c.doc_id, d.filename, c.page_start::BIGINT AS page_start FROM chunks c JOIN docs d USING (doc_id)
WHERE c.collection_id = 'n7' AND c.structural_role NOT IN ('toc','index_noise','document_summary')""")
def _(spark, sf):
    c = V.library_chunks(spark, sf).drop("filename").where(
        (F.col("collection_id") == "n7")
        & ~F.col("structural_role").isin("toc", "index_noise", "document_summary"))
    return c.join(V.library_docs(spark, sf).select("doc_id", "filename"), "doc_id").select(
        "chunk_id", "doc_id", "filename", F.col("page_start").cast("bigint").alias("page_start"))


@query("chunks_awaiting_questions", "SC-4 JN-6 SE-4", W + """
SELECT c.chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_quantity > 25
 AND l.l_orderkey = regexp_extract(c.chunk_id,'-c([0-9]+)$',1)::BIGINT)""")
def _(spark, sf):
    asked = V.table(spark, sf, "lineitem").where("l_quantity > 25").select(
        F.col("l_orderkey").alias("ord")).distinct()
    c = V.library_chunks(spark, sf).select(
        "chunk_id", F.regexp_extract("chunk_id", r"-c([0-9]+)$", 1).cast("bigint").alias("ord"))
    return c.join(asked, "ord", "left_anti").select("chunk_id")


@query("documents_with_chunk_counts", "AG-1 JN-2", W + """
SELECT d.doc_id, COALESCE(MIN(c.document_title), d.filename) AS title, d.filename, d.source_type,
 COUNT(c.chunk_id)::BIGINT AS chunk_count FROM docs d JOIN chunks c ON c.doc_id=d.doc_id
GROUP BY d.doc_id, d.filename, d.source_type""")
def _(spark, sf):
    return L.documents_with_counts(V.library_docs(spark, sf), V.library_chunks(spark, sf))


@query("collection_documents", "AG-4", W + """
SELECT d.doc_id, COALESCE(MIN(c.document_title), d.filename) AS title, d.filename, d.source_type,
 COUNT(c.chunk_id)::BIGINT AS chunk_count FROM docs d JOIN chunks c ON c.doc_id=d.doc_id
WHERE c.collection_id='n3' GROUP BY d.doc_id, d.filename, d.source_type""")
def _(spark, sf):
    return L.documents_with_counts(V.library_docs(spark, sf), V.library_chunks(spark, sf), "n3")


@query("unassigned_documents", "AG-2 JN-6", W + """
SELECT d.doc_id, COALESCE(MIN(c.document_title), d.filename) AS title, d.filename, d.source_type,
 COUNT(c.chunk_id)::BIGINT AS chunk_count FROM docs d JOIN chunks c ON c.doc_id=d.doc_id
WHERE NOT EXISTS (SELECT 1 FROM chunks x WHERE x.doc_id=d.doc_id AND x.collection_id IS NOT NULL)
GROUP BY d.doc_id, d.filename, d.source_type HAVING COUNT(c.chunk_id) > 0""")
def _(spark, sf):
    return L.unassigned_documents(V.library_docs(spark, sf), V.library_chunks(spark, sf))


@query("documents_without_summary", "JN-6", W + """
SELECT d.doc_id, d.filename, d.source_type, COALESCE(MIN(c.collection_id),'') AS collection_id,
 COALESCE(MIN(c.document_title), d.filename) AS document_title FROM docs d JOIN chunks c ON c.doc_id=d.doc_id
WHERE NOT EXISTS (SELECT 1 FROM chunks s WHERE s.doc_id=d.doc_id AND s.structural_role='document_summary')
GROUP BY d.doc_id, d.filename, d.source_type""")
def _(spark, sf):
    return L.documents_without_summary(V.library_docs(spark, sf), V.library_chunks(spark, sf))


@query("summary_status", "PR-14 PR-15", W + """
SELECT doc_id, CASE WHEN regexp_matches(filename,'^[0-9a-f]{40,}(\\.|$)') THEN regexp_replace(filename,'\\.[^.]*$','')
 ELSE filename END AS title, doc_id IN (SELECT doc_id FROM chunks WHERE structural_role='document_summary') AS has_summary
FROM docs""")
def _(spark, sf):
    return L.summary_status(V.library_docs(spark, sf), V.library_chunks(spark, sf))


@query("collections_with_counts", "AG-3 JN-3 SC-26 SO-7", W + """
SELECT c.collection_id, c.name, c.parent_id, COUNT(DISTINCT ch.doc_id)::BIGINT AS doc_count,
 COUNT(ch.chunk_id)::BIGINT AS chunk_count FROM collections c LEFT JOIN chunks ch ON ch.collection_id=c.collection_id
GROUP BY c.collection_id, c.name, c.parent_id
ORDER BY COALESCE(c.parent_id,c.collection_id), c.parent_id IS NOT NULL, c.collection_id""")
def _(spark, sf):
    return L.collections_with_counts(V.library_collections(spark, sf), V.library_chunks(spark, sf)).orderBy(
        *L.parent_first_order())


@query("collection_scopes", "JN-8 PR-6", W + """
SELECT a.collection_id AS scope_id, b.collection_id FROM collections a JOIN collections b
ON b.collection_id=a.collection_id OR b.parent_id=a.collection_id""")
def _(spark, sf):
    return L.collection_scopes(V.library_collections(spark, sf))


@query("representative_chunks", "WN-1 PR-11", W + """, x AS (SELECT doc_id, chunk_id, trim(text) AS text,
 CASE structural_role WHEN 'toc' THEN 0 WHEN 'abstract' THEN 1 WHEN 'preface' THEN 2 WHEN 'introduction' THEN 3 WHEN 'summary' THEN 4 ELSE 10 END AS r,
 COALESCE(page_start,9999) AS p FROM chunks WHERE structural_role <> 'document_summary'),
 y AS (SELECT *, sum(length(text)) OVER w AS run, row_number() OVER w AS rn FROM x
  WINDOW w AS (PARTITION BY doc_id ORDER BY r, p, chunk_id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, chunk_id FROM y WHERE run <= 120 OR rn = 1""")
def _(spark, sf):
    return L.representative_chunks(V.library_chunks(spark, sf), 120).select("doc_id", "chunk_id")


@query("chunks_in_lifted_order", "PR-12 PR-13", W + """
SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE structural_role WHEN 'toc' THEN -4
 WHEN 'abstract' THEN -3 WHEN 'preface' THEN -2 WHEN 'introduction' THEN -1 ELSE COALESCE(page_start,9999) END, chunk_id)::BIGINT AS pos
FROM chunks WHERE structural_role <> 'document_summary' AND length(trim(text)) > 0""")
def _(spark, sf):
    c = V.library_chunks(spark, sf).where(
        (F.col("structural_role") != "document_summary") & (F.length(T.strip(F.col("text"))) > 0))
    page = L._case(F.col("structural_role"), L.ROLE_LIFT, F.coalesce("page_start", F.lit(L.NO_PAGE)))
    return L.prefix.row_numbers(c, ["doc_id"], L.lifted_order(), F.floor(page / 64), "pos").select(
        "doc_id", "chunk_id", "pos")


@query("chunks_in_page_range", "PR-7 PR-8", W + """
SELECT chunk_id, COALESCE(page_start,0)::BIGINT AS page_start,
 CASE WHEN length(text)=0 THEN '' ELSE rtrim(left(text,150))||'…' END AS preview FROM chunks
WHERE structural_role NOT IN ('document_summary','page_range_summary') AND COALESCE(page_start,0) BETWEEN 10 AND 60""")
def _(spark, sf):
    return L.chunks_in_page_range(V.library_chunks(spark, sf), 10, 60).select(
        "chunk_id", F.coalesce("page_start", F.lit(0)).cast("bigint").alias("page_start"),
        T.preview(F.col("text")).alias("preview"))


SAMPLES = (("uniform", None), ("uniform", "n7"), ("top_body", None), ("top_body", "n7"))


def _sample_sql(strategy: str, collection: str | None) -> str:
    scope = f" AND collection_id = '{collection}'" if collection else ""
    step = "greatest(1, n // 30)" if strategy == "uniform" else "1"
    return f"""SELECT '{strategy}' AS strategy, '{collection or 'all'}' AS scope, ((rn-1)//{step} + 1)::BIGINT AS position, chunk_id, doc_id, text FROM (
 SELECT *, row_number() OVER (ORDER BY doc_id, COALESCE(page_start,0), chunk_id) AS rn, count(*) OVER () AS n FROM chunks
 WHERE structural_role NOT IN ('document_summary','toc') AND length(text) > 0{scope}) WHERE (rn-1) % {step} = 0 AND (rn-1)//{step} < 30"""


@query("sampled_chunk_texts", "SC-6", W + " UNION ALL ".join(_sample_sql(*x) for x in SAMPLES))
def _(spark, sf):
    c = V.library_chunks(spark, sf)
    parts = [L.sample_texts(c, 30, s, scope).select(F.lit(s).alias("strategy"), F.lit(scope or "all").alias("scope"),
                                                    "position", "chunk_id", "doc_id", "text") for s, scope in SAMPLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sample_corpus_evenly", "SC-6", """
WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM x WHERE (rn-1) % greatest(1, n//30) = 0 AND (rn-1)//greatest(1,n//30) < 30""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id")
    return L.sample_every_nth(d, 30, [F.col("doc_id")], F.floor(F.col("doc_id") / 4096))


@query("upsert_documents", "SC-15", W + """, inc AS (SELECT doc_id, filename||'.v2' AS filename, 'docx' AS source_type,
 CASE WHEN source_type='notes' THEN md5(doc_id) END AS file_hash FROM docs WHERE source_type IN ('notes','web'))
SELECT d.doc_id, CASE WHEN i.doc_id IS NULL THEN d.filename ELSE i.filename END AS filename,
 CASE WHEN i.doc_id IS NULL THEN d.source_type ELSE i.source_type END AS source_type,
 COALESCE(i.file_hash, d.file_hash) AS file_hash FROM docs d LEFT JOIN inc i USING (doc_id)""")
def _(spark, sf):
    cur = V.library_docs(spark, sf).select("doc_id", "filename", "source_type", "file_hash")
    inc = cur.where(F.col("source_type").isin("notes", "web")).select(
        "doc_id", F.concat("filename", F.lit(".v2")).alias("filename"), F.lit("docx").alias("source_type"),
        F.when(F.col("source_type") == "notes", F.md5("doc_id")).alias("file_hash"))
    return L.upsert_documents(cur, inc)


@query("upsert_latest_artifact", "SC-16 WN-7", """
SELECT user_id::VARCHAR AS doc_id, event_type AS artifact_type, max(event_id)::BIGINT AS artifact FROM events
GROUP BY 1,2""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("artifact_type"),
        F.col("event_id").alias("version"), F.col("event_id").alias("artifact"))
    return L.latest_by_key(e, ["doc_id", "artifact_type"], "version").drop("version")


@query("replace_document_chunks", "SC-17", W + """, inc AS (SELECT doc_id, chunk_id||'n' AS chunk_id FROM chunks
 WHERE source_type='notes' AND structural_role='body')
SELECT doc_id, chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM inc) UNION ALL SELECT doc_id, chunk_id FROM inc""")
def _(spark, sf):
    c = V.library_chunks(spark, sf)
    inc = c.where("source_type = 'notes' AND structural_role = 'body'").select(
        "doc_id", F.concat("chunk_id", F.lit("n")).alias("chunk_id"))
    return L.replace_by_key(c.select("doc_id", "chunk_id"), inc, ["doc_id"])


@query("chunk_provenance", "SC-17 PR-10 FN-53", W + """
SELECT c.chunk_id, c.doc_id, c.collection_id, d.filename AS source_name,
 COALESCE(NULLIF(c.document_title,''), json_extract_string(d.metadata_json,'$.title'), d.filename) AS document_title,
 COALESCE(c.source_type, d.source_type, 'pdf_book') AS source_type FROM chunks c LEFT JOIN docs d USING (doc_id)""")
def _(spark, sf):
    items = V.library_chunks(spark, sf).withColumn("source_name", F.lit(""))
    return L.with_provenance(items, V.library_docs(spark, sf))


@query("upsert_summary_chunks", "SC-19", W + """, s AS (SELECT max(doc_id)||'_summary' AS chunk_id, doc_id FROM chunks GROUP BY doc_id),
 old AS (SELECT chunk_id, doc_id, text, document_title AS title, filename AS source_name, structural_role FROM chunks
  UNION ALL SELECT chunk_id, doc_id, 'old', 'old', 'old', 'body' FROM s WHERE length(doc_id) % 2 = 0)
SELECT COALESCE(o.chunk_id, s.chunk_id) AS chunk_id, COALESCE(o.doc_id, s.doc_id) AS doc_id,
 CASE WHEN s.chunk_id IS NULL THEN o.text ELSE 'new' END AS text,
 CASE WHEN s.chunk_id IS NULL THEN o.title ELSE 'Summary' END AS title,
 CASE WHEN s.chunk_id IS NULL THEN o.source_name ELSE 'model' END AS source_name,
 COALESCE(o.structural_role, 'document_summary') AS structural_role
FROM old o FULL JOIN s ON s.chunk_id=o.chunk_id""")
def _(spark, sf):
    c = V.library_chunks(spark, sf)
    ids = c.groupBy("doc_id").agg(F.concat(F.max("doc_id"), F.lit("_summary")).alias("chunk_id"))
    cols = ["chunk_id", "doc_id", "text", "title", "source_name", "structural_role"]
    stored = ids.where(F.length("doc_id") % 2 == 0).select(
        "chunk_id", "doc_id", F.lit("old").alias("text"), F.lit("old").alias("title"),
        F.lit("old").alias("source_name"), F.lit("body").alias("structural_role"))
    old = c.select("chunk_id", "doc_id", "text", F.col("document_title").alias("title"),
                   F.col("filename").alias("source_name"), "structural_role").unionByName(stored)
    new = ids.select("chunk_id", "doc_id", F.lit("new").alias("text"), F.lit("Summary").alias("title"),
                     F.lit("model").alias("source_name"), F.lit("document_summary").alias("structural_role"))
    return L.upsert_summary_chunks(old.select(cols), new.select(cols))


@query("delete_documents_cascade", "SC-21", W + """
SELECT chunk_id, doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE source_type='web')""")
def _(spark, sf):
    docs, chunks = V.library_docs(spark, sf), V.library_chunks(spark, sf)
    return L.delete_documents(docs, chunks, docs.where("source_type = 'web'"))[1].select("chunk_id", "doc_id")


@query("delete_collection", "SC-21 OP-4", W + """
SELECT COALESCE(CASE WHEN collection_id='n5' THEN NULL ELSE collection_id END, '-') AS collection_id, count(*)::BIGINT AS n
FROM chunks GROUP BY 1""")
def _(spark, sf):
    _, c = L.delete_collection(V.library_collections(spark, sf), V.library_chunks(spark, sf), "n5")
    return c.groupBy(F.coalesce("collection_id", F.lit("-")).alias("collection_id")).agg(F.count("*").alias("n"))


@query("assign_collection", "OP-4", W + """
SELECT COALESCE(CASE WHEN doc_id IN ('d1','d2') OR source_type='docx' THEN 'n1' ELSE collection_id END,'-') AS collection_id,
 count(*)::BIGINT AS n FROM chunks GROUP BY 1""")
def _(spark, sf):
    c = L.assign_to_collection(V.library_chunks(spark, sf), "n1", ["d1", "d2"], "docx")
    return c.groupBy(F.coalesce("collection_id", F.lit("-")).alias("collection_id")).agg(F.count("*").alias("n"))


@query("stale_documents", "SC-22", W + """, inc AS (SELECT source_path, doc_id||CASE WHEN source_type='web' THEN 'x' ELSE '' END AS new_id FROM docs)
SELECT DISTINCT d.doc_id, d.source_path FROM docs d JOIN inc i USING (source_path) WHERE d.doc_id <> i.new_id""")
def _(spark, sf):
    docs = V.library_docs(spark, sf)
    inc = docs.select("source_path", F.concat("doc_id", F.when(F.col("source_type") == "web", "x").otherwise(""))
                      .alias("doc_id"))
    return L.stale_documents(docs, inc).select("doc_id", "source_path")


@query("changed_sources", "SC-23 FN-49", """
WITH stored AS (SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE lang <> 'fr')
SELECT d.doc_id, sha256(d.text) AS file_hash FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.doc_id=d.doc_id AND s.file_hash=sha256(d.text))""")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    stored = d.where("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return L.changed_sources(d.select("doc_id", "text"), stored).select("doc_id", "file_hash")


@query("corpus_health", "AG-8 PR-13", W + """
SELECT source_type, structural_role, count(*)::BIGINT AS chunks, count(document_title)::BIGINT AS titled,
 round(100.0::DOUBLE*count(document_title)/greatest(1,count(*)),2) AS titled_pct,
 count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM docs))::BIGINT AS orphaned FROM chunks GROUP BY 1,2""")
def _(spark, sf):
    c, d = V.library_chunks(spark, sf), V.library_docs(spark, sf)
    known = d.select("doc_id", F.lit(1).alias("_known"))
    n = F.count("*")
    return c.join(known, "doc_id", "left").groupBy("source_type", "structural_role").agg(
        n.alias("chunks"), F.count("document_title").alias("titled"),
        F.round(F.lit(100.0) * F.count("document_title") / F.greatest(F.lit(1), n), 2).alias("titled_pct"),
        F.count(F.when(F.col("_known").isNull(), 1)).alias("orphaned"))


_ORPHAN_SQL = """SELECT '{name}' AS listed, o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)
 WHERE k NOT IN (SELECT {value} FROM customer WHERE {where})"""
LISTED = {"solvent": ("c_custkey", "c_acctbal > 0"), "with a gap": ("CASE WHEN c_acctbal > 0 THEN c_custkey END", "c_acctbal > -500"),
          "nobody": ("c_custkey", "c_acctbal > 1e9")}


@query("orders_not_of_listed_customers", "JN-7", " UNION ALL ".join(
    _ORPHAN_SQL.format(name=n, value=v, where=w) for n, (v, w) in LISTED.items()))
def _(spark, sf):
    """NOT IN against a list without nulls, with one, and an empty one; some keys are null."""
    from vellum.operators.filters import not_in
    orders = V.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"))
    parts = [not_in(orders, V.table(spark, sf, "customer").where(w).selectExpr(f"{v} AS v"), "k", "v").select(
        F.lit(name).alias("listed"), "o_orderkey") for name, (v, w) in LISTED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("token_distribution", "AG-9", """
WITH x AS (SELECT lang, source, n_chars::DOUBLE AS v FROM documents WHERE n_chars > 0)
SELECT lang, count(v)::BIGINT AS n, min(v) AS min_value, round(quantile_cont(v,0.25),4) AS p25,
 round(quantile_cont(v,0.5),4) AS median_value, round(avg(v),4) AS mean_value, round(quantile_cont(v,0.75),4) AS p75,
 round(quantile_cont(v,0.95),4) AS p95, max(v) AS max_value, round(stddev_pop(v),4) AS stdev_pop FROM x GROUP BY lang""")
def _(spark, sf):
    return L.distribution(V.table(spark, sf, "documents").where("n_chars > 0"), "n_chars", ["lang"])


@query("display_paths", "PR-9", W + """
SELECT doc_id, source_path AS full_path, '<redacted>' AS redacted, regexp_extract(source_path,'[^/]*$') AS basename,
 regexp_replace(source_path,'^/lib/','') AS relative_path FROM docs""")
def _(spark, sf):
    from vellum.functions.paths import display_path
    p = F.col("source_path")
    return V.library_docs(spark, sf).select(
        "doc_id", display_path(p, "full").alias("full_path"), display_path(p, "redact").alias("redacted"),
        display_path(p, "basename").alias("basename"), display_path(p, "relative", "/lib").alias("relative_path"))

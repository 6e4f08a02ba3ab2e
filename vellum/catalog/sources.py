"""Sources and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.catalog import manifest as Mf, views as V
from vellum.catalog.registry import query, table
from vellum.functions import text as T
from vellum.plans import ingest, summarize
from vellum.session import ensure_checkpoint_dir
from vellum.sources import readers as R
from vellum.streaming import logs

EXTS = (".PDF", ".docx", ".py", ".md", ".CSV", ".sql", ".rst", "")


@query("source_types", "SC-7 SC-8", f"""WITH f AS (SELECT p_partkey, p_name, p_name||{V.list_sql(EXTS)}[(p_partkey%{len(EXTS)})+1] AS fn FROM part), e AS (SELECT *, lower(regexp_extract(fn,'(\\.[A-Za-z0-9]+)$',1)) AS ext FROM f)
SELECT p_partkey, ext, CASE WHEN ext IN {V.in_sql(R.CODE_EXTENSIONS)} THEN 'code' WHEN ext IN ('.md','.rst') THEN 'notes' WHEN ext='.docx' THEN 'docx' ELSE 'text' END AS source_type, left(md5(p_name),12)||'_'||p_name AS stem FROM e""")
def _(spark, sf):
    fn = F.concat("p_name", F.element_at(T.word_array(EXTS), (F.col("p_partkey") % len(EXTS) + 1).cast("int")))
    p = table(spark, sf, "part").select("p_partkey", "p_name", fn.alias("fn")).withColumn("ext", R.extension(F.col("fn")))
    return p.select("p_partkey", "ext", R.source_type(F.col("ext")).alias("source_type"),
                    R.artifact_stem(F.md5("p_name"), F.col("fn")).alias("stem"))


@query("question_answer_sources", "SC-10", """WITH p AS (SELECT a.conv_id, a.turn, trim(a.text) AS q, trim(b.text) AS an, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn)-1 AS pos FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1)
SELECT conv_id::VARCHAR AS source, pos::BIGINT AS pos, q AS title, 'Q: '||q||chr(10)||'A: '||an AS text FROM p WHERE turn % 3 <> 2""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pair = F.struct(F.when(F.col("turn") % 3 == 2, F.lit(" ")).otherwise(F.col("text")).alias("question"), "answer")
    arr = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", pair.alias("p")))), lambda s: s["p"]))
    raw = c.join(nxt, ["conv_id", "turn"]).groupBy("conv_id").agg(arr.alias("j"))
    wrapped = F.when(F.col("conv_id") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"items": '), "j", F.lit("}")))
    return R.question_answer_rows(raw.select(F.col("conv_id").cast("string").alias("source"), wrapped.alias("value"))).select(
        "source", F.col("pos").cast("bigint").alias("pos"), "title", "text")


@query("feed_items", "SC-28", """WITH h AS (SELECT regexp_extract(url,'^https?://([^/?#]*)',1) AS feed_id, page_id, url FROM pages), f AS (SELECT feed_id, url, min(page_id) AS page_id FROM h GROUP BY 1,2),
 r AS (SELECT feed_id, url, 'T & '||page_id::VARCHAR AS title, row_number() OVER (PARTITION BY feed_id ORDER BY page_id)::BIGINT AS position FROM f) SELECT feed_id, url, title, position FROM r WHERE position <= 2""")
def _(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("feed_id"), "page_id", "url")
    item = F.concat(F.lit("<item><title>T &amp; "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")),
                    F.lit("</link><description>d</description></item><item><link>ftp://x</link></item>"))
    xml = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", item.alias("x")))), lambda s: s["x"]), "\n")
    return R.feed_items(p.groupBy("feed_id").agg(xml.alias("xml")), 2).select("feed_id", "url", "title", "position")


# --- streams ------------------------------------------------------------------------
def _arriving(spark, sf, name: str):
    """A given table as a stream, be it one file or a folder of them: only a pattern may name either."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def _drain(spark, stream, mode: str = "append"):
    """Run a stream over what is there, into files, and read them back."""
    out = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4()}"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@query("streamed_event_numbers", "ST-1 ST-2", "SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq FROM events")
def _(spark, sf):
    e = _arriving(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    out = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4()}"
    logs.ingest_batches(e, logs.number_batches(out), f"{out}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").select("run_id", "event_id", "seq")


@query("streamed_topic_counts", "ST-4 ST-6", f"""WITH w AS (SELECT doc_id, unnest(list_distinct({Mf.TT.format('text')})) AS topic FROM documents)
SELECT topic, count(*)::BIGINT AS df FROM w WHERE length(topic)>=4 AND topic NOT IN {Mf.STOP} GROUP BY 1""")
def _(spark, sf):
    out = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4()}"
    docs = _arriving(spark, sf, "documents")

    def add(batch, batch_id: int) -> None:
        # One folder per batch id: a replayed batch overwrites itself, so counts stay exact.
        logs.topic_updates(batch).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    logs.ingest_batches(logs.keyword_deltas(docs), add, f"{out}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("topic").agg(F.sum("df").alias("df"))


# --- end to end ------------------------------------------------------------------------
@query("ingested_chunks", "SC-12 SC-18 SQ-2 SQ-9")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    c = ingest.prepare(d).chunks
    return c.select("chunk_id", "doc_id", "structural_role", "token_count_est", F.md5("text").alias("text_hash"))


@query("conversation_summaries", "SQ-8")
def _(spark, sf):
    parts = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    return summarize.pyramid(parts, budget=2000)

"""Jobs, conversations, uploads and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import views as V
from vellum.catalog.registry import query, table
from vellum.functions import vocab
from vellum.operators import operations as O

JOBS_SQL = """WITH jobs AS (SELECT lpad(o_orderkey::VARCHAR,10,'0') AS job_id,
 CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status,
 (o_orderkey % 5)::BIGINT AS attempts, 3::BIGINT AS max_attempts, o_orderdate::TIMESTAMP AS created_at,
 NULL::VARCHAR AS error, NULL::TIMESTAMP AS finished_at FROM orders)"""


def jobs(spark, sf):
    st = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("job_id"),
        F.when(st == "O", "pending").when(st == "P", "running").otherwise("done").alias("status"),
        (F.col("o_orderkey") % 5).alias("attempts"), F.lit(3).cast("bigint").alias("max_attempts"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"))


def messages(spark, sf):
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("conversation_id"),
        "role", F.col("text").alias("content"), F.col("turn").alias("sequence"))


CONV_SQL = """WITH msgs AS (SELECT conv_id::VARCHAR||'-'||turn::VARCHAR AS message_id, conv_id AS conversation_id, role,
 text AS content, turn AS sequence FROM conversations),
convs AS (SELECT user_id AS conversation_id, min(ts) AS created_at, max(ts) AS updated_at,
 CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS archived FROM events GROUP BY user_id)"""


def conversations(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("conversation_id")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")).withColumn(
        "archived", F.when(F.col("conversation_id") % 4 == 0, 1).otherwise(0).cast("bigint"))


NOW = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"


@query("claim_next_job", "OP-1 SO-5", JOBS_SQL + """, pick AS (SELECT job_id FROM jobs WHERE status='pending' AND attempts < max_attempts
 ORDER BY created_at, job_id LIMIT 1)
SELECT status, sum(attempts)::BIGINT AS attempts, count(*)::BIGINT AS n, count(started_at)::BIGINT AS started FROM (
 SELECT CASE WHEN p.job_id IS NOT NULL THEN 'running' ELSE j.status END AS status,
  j.attempts + CASE WHEN p.job_id IS NOT NULL THEN 1 ELSE 0 END AS attempts,
  CASE WHEN p.job_id IS NOT NULL THEN 1 END AS started_at FROM jobs j LEFT JOIN pick p USING (job_id)) GROUP BY status""")
def _(spark, sf):
    after = O.claim_next_job(jobs(spark, sf), F.expr(NOW))
    return after.groupBy("status").agg(F.sum("attempts").alias("attempts"), F.count("*").alias("n"),
                                       F.count("started_at").alias("started"))


@query("fail_jobs_with_retry", "OP-2", JOBS_SQL + """
SELECT job_id, CASE WHEN status='running' AND attempts < max_attempts THEN 'pending' WHEN status='running' THEN 'failed' ELSE status END AS status,
 CASE WHEN status='running' THEN 'boom '||job_id END AS error, status='running' AS finished FROM jobs""")
def _(spark, sf):
    j = jobs(spark, sf)
    failures = j.where("status = 'running'").select("job_id", F.concat(F.lit("boom "), "job_id").alias("error"))
    return O.fail_jobs(j, failures, F.expr(NOW)).select(
        "job_id", "status", "error", F.col("finished_at").isNotNull().alias("finished"))


@query("cancel_jobs", "OP-2", JOBS_SQL + """
SELECT status, cancelled, count(*)::BIGINT AS n FROM (SELECT
 attempts=1 AND status IN ('pending','running') AS cancelled,
 CASE WHEN attempts=1 AND status IN ('pending','running') THEN 'cancelled' ELSE status END AS status FROM jobs) GROUP BY 1,2""")
def _(spark, sf):
    j = jobs(spark, sf)
    return O.cancel_jobs(j, j.where("attempts = 1"), F.expr(NOW)).groupBy("status", "cancelled").agg(
        F.count("*").alias("n"))


@query("newest_jobs", "OP-3 SO-6", JOBS_SQL + """
SELECT job_id, status, created_at FROM jobs WHERE status='done' ORDER BY created_at DESC, job_id LIMIT 25""")
def _(spark, sf):
    return O.newest(jobs(spark, sf), "created_at", "job_id", 25, "done").select("job_id", "status", "created_at")


@query("active_uploads", "OP-9 WN-12", """
WITH u AS (SELECT event_id AS job_id, ts AS queued_at, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued'
 WHEN 'signup' THEN 'uploading' ELSE 'done' END AS status FROM events)
SELECT job_id, status, CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN
 row_number() OVER (PARTITION BY status ORDER BY queued_at, job_id) END::BIGINT AS queue_position
FROM u WHERE status IN ('running','queued','uploading')""")
def _(spark, sf):
    et = F.col("event_type")
    u = table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.col("ts").alias("queued_at"),
        F.when(et == "click", "running").when(et == "view", "queued").when(et == "signup", "uploading")
        .otherwise("done").alias("status"))
    return O.active_uploads(u).select("job_id", "status", "queue_position")


@query("conversations_newest_first", "AG-5 JN-4 SO-6", CONV_SQL + """
SELECT c.conversation_id, c.updated_at, count(m.message_id)::BIGINT AS message_count FROM convs c LEFT JOIN msgs m USING (conversation_id)
WHERE c.archived = 0 GROUP BY 1,2 ORDER BY c.updated_at DESC, c.conversation_id LIMIT 30""")
def _(spark, sf):
    return O.conversations_with_counts(conversations(spark, sf), messages(spark, sf), 30).select(
        "conversation_id", "updated_at", "message_count")


@query("next_message_sequence", "AG-6", CONV_SQL + """
SELECT conversation_id, (COALESCE(max(sequence),0)+1)::BIGINT AS next_sequence FROM msgs GROUP BY 1""")
def _(spark, sf):
    return O.next_sequences(messages(spark, sf))


@query("archive_stale_conversations", "OP-5 FN-54", CONV_SQL + """
SELECT conversation_id, CASE WHEN archived=0 AND updated_at < TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 7 DAY THEN 1 ELSE archived END::BIGINT AS archived FROM convs""")
def _(spark, sf):
    return O.archive_stale(conversations(spark, sf), F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'"), 7).select(
        "conversation_id", F.col("archived").cast("bigint").alias("archived"))


@query("compress_conversations", "WN-6 OP-5", CONV_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence DESC) AS back,
 count(*) OVER (PARTITION BY conversation_id) AS n FROM msgs)
SELECT conversation_id, sequence FROM r WHERE n < 4 OR back <= 2""")
def _(spark, sf):
    m = messages(spark, sf)
    return O.compress(m, O.compression_boundaries(m, threshold=4, keep_recent=2)).select(
        "conversation_id", "sequence")


@query("follow_up_rewrites", "FN-52", CONV_SQL + """, ent AS (SELECT conversation_id, sequence, list_filter(
  regexp_extract_all(content, '\\b([A-Z][A-Za-z]{1,}(?:\\s+[A-Z][A-Za-z]{1,})*)\\b', 1),
  lambda m: length(m) > 2 AND NOT list_contains(""" + V.list_sql(vocab.NOT_ENTITY) + """, regexp_extract(m, '^\\S+'))) AS es FROM msgs),
 off AS (SELECT conversation_id, sequence, es[-1] AS entity, unnest(range(sequence+1, sequence+4)) AS pos FROM ent WHERE len(es) > 0),
 best AS (SELECT conversation_id, pos AS sequence, arg_max(entity, sequence) AS entity FROM off GROUP BY 1,2)
SELECT m.conversation_id, m.sequence, CASE WHEN b.entity IS NULL THEN m.content ELSE 'Regarding '||b.entity||': '||""" + V.strip_sql("m.content") + """ END AS query
FROM msgs m LEFT JOIN best b ON b.conversation_id=m.conversation_id AND b.sequence=m.sequence WHERE m.role='user' AND """ + V.word_count_sql("m.content") + " <= 12")
def _(spark, sf):
    return O.follow_up_rewrites(messages(spark, sf))


@query("progress_states", "OP-8", """
WITH m AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' Branch Safety: 12 of 40' WHEN 'view' THEN 'Saved Checkpoint for run'
 WHEN 'signup' THEN 'Ingesting 3 sources' WHEN 'error' THEN 'ERROR: lost node' ELSE 'Report saved to: x.md' END AS msg FROM events),
 l AS (SELECT event_id, lower(trim(msg)) AS t FROM m)
SELECT event_id, CASE WHEN t LIKE '%ingesting%' THEN 'ingestion' WHEN t LIKE 'branch %' THEN 'running'
 WHEN t LIKE '%saved%' AND t LIKE '%checkpoint%' THEN 'running' WHEN t LIKE '%report saved to:%' THEN 'report'
 WHEN t LIKE 'error%' THEN 'error' ELSE 'running' END AS phase,
 CASE WHEN t LIKE '%ingesting%' THEN 'ingesting' WHEN t LIKE 'branch %' THEN 'branch_start'
 WHEN t LIKE '%saved%' AND t LIKE '%checkpoint%' THEN 'checkpointing' WHEN t LIKE '%report saved to:%' THEN 'report_saved'
 WHEN t LIKE 'error%' THEN 'error' ELSE 'progress' END AS stage,
 CASE WHEN t LIKE '%ingesting%' THEN 8 WHEN t LIKE 'branch %' THEN 30
 WHEN t LIKE '%saved%' AND t LIKE '%checkpoint%' THEN 68 WHEN t LIKE '%report saved to:%' THEN 96 END::BIGINT AS percent_hint FROM l""")
def _(spark, sf):
    et = F.col("event_type")
    msg = (F.when(et == "click", " Branch Safety: 12 of 40").when(et == "view", "Saved Checkpoint for run")
           .when(et == "signup", "Ingesting 3 sources").when(et == "error", "ERROR: lost node")
           .otherwise("Report saved to: x.md"))
    phase, stage, pct = O.progress_state(F.col("msg"))
    return table(spark, sf, "events").select("event_id", msg.alias("msg")).select(
        "event_id", phase.alias("phase"), stage.alias("stage"), pct.alias("percent_hint"))


@query("sequence_run_events", "ST-2", """
SELECT event_id, user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("run_id"), "ts")
    return O.sequence_events(e).select("event_id", "run_id", "seq")


RUNS_SQL = """WITH runs AS (SELECT event_id AS run_id, (user_id % 37)::BIGINT AS project_slug, ts AS started_at,
 CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'done' WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'cancel_requested' ELSE 'error' END AS status,
 json_extract_string(props,'$.k')::BIGINT AS last_seq FROM events)"""


def runs(spark, sf):
    et = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), (F.col("user_id") % 37).alias("project_slug"),
        F.col("ts").alias("started_at"),
        F.when(et == "click", "running").when(et == "view", "done").when(et == "signup", "queued")
        .when(et == "error", "cancel_requested").otherwise("error").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("last_seq"),
        F.lit(None).cast("string").alias("error"))


@query("latest_run_per_project", "WN-7 OP-10", RUNS_SQL + """
SELECT project_slug, arg_max(run_id, (started_at, run_id))::BIGINT AS run_id, max(started_at) AS started_at FROM runs GROUP BY 1""")
def _(spark, sf):
    return O.latest_per_project(runs(spark, sf))


@query("active_run_per_project", "OP-10", RUNS_SQL + """
SELECT project_slug, arg_max(run_id, (started_at, run_id))::BIGINT AS run_id, max(started_at) AS started_at FROM runs
WHERE status IN ('queued','running') GROUP BY 1""")
def _(spark, sf):
    return O.latest_per_project(runs(spark, sf), active_only=True)


@query("reconcile_interrupted_runs", "OP-7", RUNS_SQL + """
SELECT status, count(*)::BIGINT AS n, sum(last_seq)::BIGINT AS seqs FROM (SELECT
 CASE WHEN status IN ('queued','running','cancel_requested') THEN 'error' ELSE status END AS status,
 last_seq + CASE WHEN status IN ('queued','running','cancel_requested') THEN 1 ELSE 0 END AS last_seq FROM runs) GROUP BY 1
UNION ALL SELECT 'appended', count(*)::BIGINT, sum(last_seq+1)::BIGINT FROM runs WHERE status IN ('queued','running','cancel_requested')""")
def _(spark, sf):
    after, events = O.reconcile_interrupted(runs(spark, sf))
    a = after.groupBy("status").agg(F.count("*").alias("n"), F.sum("last_seq").alias("seqs"))
    return a.unionByName(events.agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))
                         .select(F.lit("appended").alias("status"), "n", "seqs"))


@query("web_cache_lookup", "SC-25 ST-5", """
WITH c AS (SELECT sha256(event_type||'|'||user_id::VARCHAR) AS key, event_id AS value, ts + INTERVAL 24 HOUR AS expires_at FROM events)
SELECT key, arg_max(value, (expires_at, value))::BIGINT AS value, max(expires_at) AS expires_at FROM c
WHERE expires_at >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY key""")
def _(spark, sf):
    c = table(spark, sf, "events").select(
        F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("key"),
        F.col("event_id").alias("value"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    return O.live_cache_entries(c, F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"))

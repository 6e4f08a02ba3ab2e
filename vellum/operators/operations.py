"""Conversations, jobs and run logs as projections of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import text as T, vocab
from vellum.operators import prefix

ACTIVE_UPLOADS = {"running": 0, "queued": 1, "uploading": 2}
INTERRUPTED = ("queued", "running", "cancel_requested")
CANCELLABLE = ("pending", "running")


# --- jobs -------------------------------------------------------------------------
def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest pending job that still has attempts left."""
    return (jobs.where((F.col("status") == "pending") & (F.col("attempts") < F.col("max_attempts")))
            .orderBy("created_at", "job_id").limit(1))


def claim_next_job(jobs: DataFrame, now: Column) -> DataFrame:
    """Job table after its single writer claims the next job."""
    chosen = next_job(jobs).select("job_id", F.lit(True).alias("_claimed"))
    j = jobs.join(chosen, "job_id", "left")
    hit = F.col("_claimed").isNotNull()
    return j.select(*[
        F.when(hit, F.lit("running")).otherwise(F.col(c)).alias(c) if c == "status"
        else F.when(hit, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "attempts"
        else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "started_at"
        else F.col(c) for c in jobs.columns])


def fail_jobs(jobs: DataFrame, failures: DataFrame, now: Column, retry: bool = True) -> DataFrame:
    """Record failures (job_id, error); with attempts left the job returns to pending."""
    f = failures.select("job_id", F.substring("error", 1, 2000).alias("_err"))
    hit = F.col("_err").isNotNull()
    again = (F.col("attempts") < F.col("max_attempts")) if retry else F.lit(False)
    return jobs.join(f, "job_id", "left").withColumns({
        "status": F.when(hit & again, "pending").when(hit, "failed").otherwise(F.col("status")),
        "error": F.coalesce("_err", "error"),
        "finished_at": F.when(hit, now).otherwise(F.col("finished_at"))}).drop("_err")


def cancel_jobs(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    asked = ids.select("job_id").distinct().withColumn("_asked", F.lit(True))
    j = jobs.join(asked, "job_id", "left")
    hit = F.col("_asked").isNotNull() & F.col("status").isin(*CANCELLABLE)
    return j.withColumns({
        "cancelled": hit,
        "status": F.when(hit, "cancelled").otherwise(F.col("status")),
        "error": F.when(hit, "Cancelled by user").otherwise(F.col("error")),
        "finished_at": F.when(hit, now).otherwise(F.col("finished_at"))}).drop("_asked")


def complete_job(jobs: DataFrame, job_id: str, now: Column) -> DataFrame:
    hit = F.col("job_id") == job_id
    return jobs.withColumns({"status": F.when(hit, "done").otherwise(F.col("status")),
                             "finished_at": F.when(hit, now).otherwise(F.col("finished_at"))})


def newest(df: DataFrame, at: str, key: str, limit: int, status: str | None = None) -> DataFrame:
    if status:
        df = df.where(F.col("status") == status)
    return df.orderBy(F.desc(at), key).limit(limit)


def active_uploads(uploads: DataFrame) -> DataFrame:
    """Active uploads with their queue position: 0 running, 1..n queued, none while uploading."""
    act = uploads.where(F.col("status").isin(*ACTIVE_UPLOADS))
    queued = prefix.row_numbers(act.where("status = 'queued'"), [], [F.col("queued_at"), F.col("job_id")],
                                F.to_date("queued_at"), "queue_position")
    rest = act.where("status <> 'queued'").withColumn(
        "queue_position", F.when(F.col("status") == "running", F.lit(0)).cast("bigint"))
    return queued.unionByName(rest)


# --- conversations ------------------------------------------------------------------
def conversations_with_counts(conversations: DataFrame, messages: DataFrame, limit: int | None = None,
                              include_archived: bool = False) -> DataFrame:
    if not include_archived:
        conversations = conversations.where("archived = 0")
    n = messages.groupBy("conversation_id").agg(F.count("message_id").alias("_n"))
    out = conversations.join(n, "conversation_id", "left").withColumn(
        "message_count", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")
    return out.orderBy(F.desc("updated_at"), "conversation_id").limit(limit) if limit else out


def next_sequences(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(
        (F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("next_sequence"))


def archive_stale(conversations: DataFrame, as_of: Column, days: int) -> DataFrame:
    stale = (F.col("archived") == 0) & (F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days)))
    return conversations.withColumn("archived", F.when(stale, 1).otherwise(F.col("archived")))


def compression_boundaries(messages: DataFrame, threshold: int = 20, keep_recent: int = 10) -> DataFrame:
    """Per long conversation, the first sequence that stays verbatim.

    The sequences of a conversation are dense, so the boundary follows from the
    maximum; no group is sorted.
    """
    stats = messages.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.max("sequence").alias("last"), F.min("sequence").alias("first"))
    return stats.where((F.col("n") >= threshold) & (F.col("n") > keep_recent)).select(
        "conversation_id", (F.col("last") - keep_recent + 1).alias("keep_from"))


def compress(messages: DataFrame, boundaries: DataFrame) -> DataFrame:
    return messages.join(boundaries, "conversation_id", "left").where(
        F.col("keep_from").isNull() | (F.col("sequence") >= F.col("keep_from"))).drop("keep_from")


def last_entity(content: Column) -> Column:
    """The last proper noun phrase of a message, stop phrases excluded."""
    found = F.regexp_extract_all(T.text_or_empty(content), F.lit(vocab.ENTITY_PHRASE), F.lit(1))
    good = F.filter(found, lambda m: ~F.regexp_extract(m, r"^\S+", 0).isin(vocab.NOT_ENTITY)
                    & (F.length(m) > 2))
    return F.when(F.size(good) > 0, F.element_at(good, -1))


def follow_up_rewrites(messages: DataFrame, look_back: int = 3, max_words: int = 12) -> DataFrame:
    """Short user messages rewritten with the latest entity of the preceding messages.

    Each message offers its entity to the next ``look_back`` positions, which keeps
    the work spread over (conversation, position) instead of sorting conversations.
    """
    offers = (messages.select("conversation_id", "sequence", last_entity(F.col("content")).alias("entity"))
              .where(F.col("entity").isNotNull())
              .select("conversation_id", F.col("sequence").alias("_src"), "entity",
                      F.explode(F.sequence(F.col("sequence") + 1, F.col("sequence") + look_back))
                      .alias("sequence")))
    best = offers.groupBy("conversation_id", "sequence").agg(F.max_by("entity", "_src").alias("entity"))
    q = T.strip(F.col("content"))
    asks = messages.where((F.col("role") == "user") & (T.word_count(F.col("content")) <= max_words))
    return asks.join(best, ["conversation_id", "sequence"], "left").select(
        "conversation_id", "sequence",
        F.when(F.col("entity").isNull(), F.col("content"))
        .otherwise(F.concat(F.lit("Regarding "), F.col("entity"), F.lit(": "), q)).alias("query"))


# --- run logs -------------------------------------------------------------------------
def progress_state(message: Column) -> tuple[Column, Column, Column]:
    """(phase, stage, percent) of a progress message; the first matching rule wins."""
    low = F.lower(T.strip(message))

    def holds(test: str) -> Column:
        kind, arg = test.split(":", 1)
        if kind == "starts":
            return low.startswith(arg)
        if kind == "has":
            return low.contains(arg)
        return T.contains_any(low, [arg.split("|")[0]]) & T.contains_any(low, [arg.split("|")[1]])

    phase, stage, pct = F, F, F
    for tests, ph, st, hint in vocab.PROGRESS_RULES:
        cond = F.lit(False)
        for t in tests:
            cond = cond | holds(t)
        phase, stage = phase.when(cond, F.lit(ph)), stage.when(cond, F.lit(st))
        pct = pct.when(cond, F.lit(hint).cast("bigint"))
    return (phase.otherwise("running"), stage.otherwise("progress"), pct.otherwise(None))


def sequence_events(events: DataFrame) -> DataFrame:
    """Number each run's events in arrival order, one time bucket at a time."""
    return prefix.row_numbers(events, ["run_id"], [F.col("ts"), F.col("event_id")],
                              F.date_trunc("hour", "ts"), "seq")


def latest_per_project(runs: DataFrame, active_only: bool = False) -> DataFrame:
    if active_only:
        runs = runs.where(F.col("status").isin("queued", "running"))
    return runs.groupBy("project_slug").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"),
        F.max("started_at").alias("started_at"))


def reconcile_interrupted(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs after a restart, and the events appended to the interrupted ones."""
    hit = F.col("status").isin(*INTERRUPTED)
    why = F.lit("Server restarted during extraction run")
    new_events = runs.where(hit).select(
        "run_id", (F.col("last_seq") + 1).alias("seq"), F.lit("error").alias("type"), why.alias("message"))
    after = runs.withColumns({
        "error": F.when(hit, why).otherwise(F.col("error")),
        "last_seq": F.when(hit, F.col("last_seq") + 1).otherwise(F.col("last_seq")),
        "status": F.when(hit, "error").otherwise(F.col("status"))})
    return after, new_events


def live_cache_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Newest unexpired value per key; a key is the hash of its parts."""
    live = cache.where(F.col("expires_at") >= now)
    return live.groupBy("key").agg(F.max_by("value", F.struct("expires_at", "value")).alias("value"),
                                   F.max("expires_at").alias("expires_at"))


def source_momentum(steps: Column, source: str, last: int = 3) -> Column:
    """How many of the most recent ``last`` steps used ``source``."""
    tail = F.slice(steps, F.greatest(F.lit(1), F.size(steps) - last + 1), last)
    return F.size(F.filter(tail, lambda s: s == source))

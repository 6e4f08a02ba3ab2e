"""Run logs, caches and the topic manifest as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum import schemas
from vellum.operators import manifest, prefix

TERMINAL = ("done", "error", "cancelled")


def tail_run_log(spark: SparkSession, path: str, schema: str = schemas.RUN_EVENT) -> DataFrame:
    """New lines of append-only run logs as they land; Spark's offsets replace the polling cursor."""
    return spark.readStream.schema(schema).json(path)


def run_status(events: DataFrame) -> DataFrame:
    """Latest event per run (update mode)."""
    return events.groupBy("run_id").agg(F.max("seq").alias("last_seq"), F.max_by("type", "seq").alias("last_type"),
                                        F.max(F.col("type").isin(*TERMINAL).cast("int")).alias("finished"))


def number_batches(path: str):
    """A ``foreachBatch`` sink that gives every event (run_id, event_id, ts) the next sequence of its run.

    Events of one trigger are numbered in (ts, event_id) order, hour by hour, so a busy run is
    neither sorted nor held in one task; the last number of each run so far lies in ``path``/last.
    A replayed batch overwrites its own folders and starts from its predecessor's, so numbers
    stay the same.
    """
    def number(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = prefix.row_numbers(batch.select("run_id", "event_id", "ts"), ["run_id"], [F.col("ts"), F.col("event_id")],
                                  F.date_trunc("hour", "ts"), "seq")
        before = spark.createDataFrame([], rows.select("run_id", "seq").schema)
        if batch_id:
            before = spark.read.schema(before.schema).parquet(f"{path}/last/batch={batch_id - 1}")
        known = before.select(F.col("run_id").alias("_run"), F.col("seq").alias("_last"))
        numbered = rows.join(known, F.col("run_id").eqNullSafe(F.col("_run")), "left").select(
            "run_id", "event_id", (F.col("seq") + F.coalesce("_last", F.lit(0))).alias("seq"))
        numbered.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        written = spark.read.schema(numbered.schema).parquet(f"{path}/data/batch={batch_id}")
        (before.unionByName(written.select("run_id", "seq")).groupBy("run_id").agg(F.max("seq").alias("seq"))
         .write.mode("overwrite").parquet(f"{path}/last/batch={batch_id}"))

    return number


def cache_with_ttl(writes: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """(key, value, expires_at) as entries change; an expired key leaves the state by event-time timeout.

    writes(key, value, ts) must carry a watermark on ``ts``.
    """
    def keep(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for pdf in batches:
            row = pdf.loc[pdf["ts"].idxmax()]
            stamp = int(row["ts"].timestamp() * 1000)
            if best is None or stamp >= best[1]:
                best = (str(row["value"]), stamp)
        state.update(best)
        state.setTimeoutTimestamp(max(best[1] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "value": [best[0]], "expires_at": [pd.Timestamp(best[1] + ttl_ms, unit="ms")]})

    return writes.groupBy("key").applyInPandasWithState(
        keep, "key string, value string, expires_at timestamp", "value string, stamp bigint", "update",
        GroupStateTimeout.EventTimeTimeout)


def topic_updates(arriving: DataFrame) -> DataFrame:
    """Topic counts kept current from keyword deltas (keyword, delta) in update mode."""
    return arriving.groupBy(F.col("keyword").alias("topic")).agg(F.sum("delta").alias("df"))


def ingest_batches(documents: DataFrame, sink, checkpoint: str):
    """Hand every micro-batch to ``sink(batch, id)``: the polling worker as a trigger."""
    return documents.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def keyword_deltas(docs: DataFrame) -> DataFrame:
    """Stateless part of the manifest stream: distinct topic words of each arriving document."""
    return docs.select("doc_id", F.explode(F.array_distinct(manifest.topic_tokens(F.col("text")))).alias("keyword")).withColumn(
        "delta", F.lit(1).cast("bigint"))

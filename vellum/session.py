"""Session defaults shared by tests, the bench and applications.

Only planner-level settings live here.  Cluster sizing (executors, memory) and
``spark.checkpoint.dir`` belong to the deployment and are read from the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """Create (or fetch) a session carrying the engine's planner settings."""
    builder = SparkSession.builder.appName("vellum")
    if master:
        builder = builder.master(master)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only when that
    is absent and the master is local (tests) do we pick a folder ourselves.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="vellum-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def stored_rows(rows: DataFrame) -> DataFrame:
    """``rows`` written by columns to a folder of their own among the checkpoints, and read back.

    Unlike ``checkpoint()`` this compresses, and later steps read only the columns they need.
    """
    path = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

"""Writing artifacts, reports, checkpoints and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_artifact(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """A stage's output; the next stage reads it back, which also cuts lineage."""
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def append_trace(df: DataFrame, path: str) -> None:
    """Append trace rows as JSON lines in one folder per day; size rotation becomes day folders."""
    df.withColumn("day", F.current_date()).write.mode("append").partitionBy("day").json(path)


def append_checkpoint(branch_rows: DataFrame, path: str) -> None:
    branch_rows.write.mode("append").partitionBy("branch_name").json(path)


def load_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def pending_branches(wanted: list[str], checkpoint: DataFrame) -> list[str]:
    """Branches still to run, in order; the checkpoint holds at most one name per configured branch."""
    done = {r[0] for r in checkpoint.where(F.col("branch_name").isin(wanted)).select("branch_name").distinct().collect()}
    return [b for b in wanted if b not in done]


def write_report(lines: DataFrame, path: str) -> None:
    """Report rows (section, line_no, line) as text, ordered across and within part files."""
    (lines.repartitionByRange(F.col("section"), F.col("line_no")).sortWithinPartitions("section", "line_no")
     .select("line").write.mode("overwrite").text(path))

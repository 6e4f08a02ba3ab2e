"""Running sums and row numbers that do not funnel a group, or the table, through one task.

``bucket`` is any expression that never decreases along the sort order (a date
part, an id divided by a constant, the first characters of an id).  Rows are
summed per (keys, bucket); a window over those few totals gives each bucket its
starting offset; the fine window then runs per (keys, bucket) only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.session import ensure_checkpoint_dir


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                value: Column, name: str) -> DataFrame:
    """Add ``name``: the inclusive running sum of ``value`` within ``keys`` along ``order``."""
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket",
                            F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_offset"))
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cond = F.col("r._bucket").eqNullSafe(F.col("o._bucket"))
    for k in keys:
        cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = rows.alias("r").join(offsets.alias("o"), cond).select("r.*", "o._offset")
    return (joined.withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
            .drop("_bucket", "_value", "_offset"))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                name: str) -> DataFrame:
    """Add ``name``: the 1-based position within ``keys`` along a total ``order``."""
    return running_sum(df, keys, order, bucket, F.lit(1).cast("bigint"), name)


def keep_within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                       length: Column, budget: int) -> DataFrame:
    """Rows of each group up to the first one that would overflow ``budget``.

    The first row always stays.  Lengths are positive, so the running total is
    strictly increasing and stopping at the first overflow equals a prefix test.
    """
    out = running_sum(df.withColumn("_len", length), keys, order, bucket, F.col("_len"), "_run")
    return out.where((F.col("_run") <= budget) | (F.col("_run") == F.col("_len"))).drop("_len", "_run")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the 1-based position within ``keys`` along a total ``order`` of any kind.

    Rows are dealt by ranges of (keys, order), so that neither a hot key nor a run of equal scores is one
    task's, and the partitions are the buckets: their counts give the offsets.  The dealt rows are kept in
    the checkpoint folder, because ranges drawn anew could differ between the two uses.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    return row_numbers(dealt, keys, order, F.col("_range"), name).drop("_range")

"""Registry of runnable queries: one Spark callable plus, where SQL can state it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: QueryFn
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn`` under ``name``; ``covers`` lists the inventory ids it implements."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, fn, sql, tuple(covers.split()))
        return fn

    return wrap


TEXT_TABLES = ("documents", "pages")
SMALL_INPUT = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a small text file is spread over the cores before CPU-heavy work.

    One row group is one task however many cores wait.  Only inputs below
    ``SMALL_INPUT`` bytes are spread, so a large table is never shuffled for it.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES and scan_bytes(df) < SMALL_INPUT:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def scan_bytes(df: DataFrame) -> int:
    """Size of the input files as the planner sees it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

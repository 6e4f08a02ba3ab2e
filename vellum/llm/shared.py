"""Helpers of the training-text operators: shared storage, words, row helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = "\x20\t\n\x0b\x0c\r"


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for one job's tables, below the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``; where the setting is absent the
    warehouse folder, which executors share as well, takes its place.
    """
    conf = spark.sparkContext.getConf()
    base = (spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
            or spark.conf.get("spark.sql.warehouse.dir") + "/_work")
    return f"{base.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def as_table(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later work starts from files, so a
    lost executor costs its tasks only and nothing upstream runs twice."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of :func:`as_table` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, as ``doc_id`` and ``text`` (null text: empty)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


_held: dict[tuple, object] = {}


def worker_memory(make, *key):
    """``make(*key)``, kept in the worker process until something else is asked for.

    Python workers live on from stage to stage.  What one stage has learnt of a vocabulary must not stay
    beside what the next one learns, so a worker holds one such object at a time.
    """
    asked = (make.__module__, make.__qualname__, *key)
    if asked not in _held:
        _held.clear()
        _held[asked] = make(*key)
    return _held[asked]


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies (a caller may pass any other path instead)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

"""The corpus pipeline: quality classifier, quality rules, near-duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import fertility, near_copies, ordinal, packing
from vellum.llm.queries import digest_pieces
from vellum.llm.shared import as_table, table, work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are sound, not poor or toxic, with a probability of at least a half."""
    model = ordinal.train(table(spark, sf_dir, "documents"), ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.keep_selected(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language or script."""
    return fertility.keep_sound(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are alike to 0.8 or more."""
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the kept documents in one piece of one sequence of at most 2048 tokens."""
    return digest_pieces(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: SQL has no tokeniser, so the packed rows are checked against a brute-force version in tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark)
    for n, (_, stage) in enumerate(STAGES):
        docs = as_table(stage(spark, docs, sf_dir), f"{folder}/stage{n}")
    return docs

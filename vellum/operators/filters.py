"""Retrieval filters compiled to predicates, so scans receive them before any scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class RetrievalFilters:
    doc_id: str | None = None
    doc_ids: Sequence[str] = ()
    path_prefix: str | None = None
    page_min: int | None = None
    page_max: int | None = None
    has_table: bool | None = None
    source_type: str | None = None
    structural_role: str | None = None
    collection_id: str | None = None

    def hard(self) -> bool:
        """True when the caller pinned documents, paths or pages (strategy then steps aside)."""
        return any((self.doc_id, self.doc_ids, self.path_prefix, self.page_min is not None,
                    self.page_max is not None, self.has_table is not None,
                    self.source_type, self.structural_role))


def predicate(f: RetrievalFilters) -> Column:
    """Every filter except the collection scope; a list of ids outranks a single id."""
    terms: list[Column] = []
    if f.doc_ids:
        terms.append(F.col("doc_id").isin(*f.doc_ids))
    elif f.doc_id:
        terms.append(F.col("doc_id") == f.doc_id)
    if f.path_prefix:
        # Caller text is not escaped: % and _ stay wildcards.
        terms.append(F.col("path_text").like(f.path_prefix + "%"))
    if f.page_min is not None:
        terms.append(F.col("page_end").isNull() | (F.col("page_end") >= f.page_min))
    if f.page_max is not None:
        terms.append(F.col("page_start").isNull() | (F.col("page_start") <= f.page_max))
    if f.has_table is not None:
        terms.append(F.col("has_table") == F.lit(f.has_table))
    if f.source_type:
        terms.append(F.col("source_type") == f.source_type)
    if f.structural_role:
        terms.append(F.col("structural_role") == f.structural_role)
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def compile_filters(chunks: DataFrame, f: RetrievalFilters,
                    collections: DataFrame | None = None) -> DataFrame:
    out = chunks.where(predicate(f))
    if f.collection_id:
        own = F.col("collection_id") == f.collection_id
        if collections is None:
            return out.where(own)
        scope = collections.where(own | (F.col("parent_id") == f.collection_id)).select("collection_id")
        out = out.join(scope, "collection_id", "left_semi")
    return out


def not_in(left: DataFrame, right: DataFrame, key: str, among: str) -> DataFrame:
    """``left`` rows whose ``key`` is NOT IN the ``among`` values of ``right``, with SQL's nulls.

    A null among the values makes every answer unknown, and so no rows; a null key is unknown too, unless there
    are no values.  Both facts are one aggregate, so the rest is a plain anti join that can be dealt by key.
    """
    facts = right.agg(F.count("*").alias("n"), F.count(F.when(F.col(among).isNull(), 1)).alias("nulls"))
    values = right.where(F.col(among).isNotNull()).select(F.col(among).alias(key)).distinct()
    n, nulls = facts.select("n").scalar(), facts.select("nulls").scalar()
    return left.join(values, key, "left_anti").where((n == 0) | ((nulls == 0) & F.col(key).isNotNull()))

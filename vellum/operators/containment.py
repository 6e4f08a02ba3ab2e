"""Substring containment of many terms: one automaton for a group of queries, one pass over the texts.

Containment has no join key, so the asked terms travel to the texts.  Queries are cut into groups by a hash
of their id; the terms of one group make one Aho-Corasick automaton, which every task runs once over each of
its texts, whatever the number of terms.  Each group is one scan of the texts: the driver holds one group at a
time, about ``GROUP`` queries, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

GROUP = 256
#: Terms that stand for one query where only their number matters.
TERM_GROUP = 20_000


class Matcher:
    """What a group of queries asks: terms with the queries they count for and by how much."""

    def __init__(self, asked: list[tuple[int, str, int]]) -> None:
        """``asked`` holds (place of the query, term, weight)."""
        by_term: dict[str, list[tuple[int, int]]] = {}
        for place, term, weight in asked:
            by_term.setdefault(term, []).append((place, weight))
        self.automaton = ahocorasick.Automaton()
        self.places, self.weights = [], []
        for n, (term, pairs) in enumerate(by_term.items()):
            self.automaton.add_word(term, n)
            places, weights = zip(*pairs)
            self.places.append(np.array(places))
            self.weights.append(np.array(weights))
        if by_term:
            self.automaton.make_automaton()
        self.size = 1 + max((place for place, _, _ in asked), default=-1)

    def counts(self, text: str) -> np.ndarray:
        """Weight of the terms found in ``text``, by query."""
        total = np.zeros(self.size, np.int64)
        for n in {n for _, n in self.automaton.iter(text)} if self.places else ():
            total[self.places[n]] += self.weights[n]  # a query asks a term once
        return total


def _matched(sent, key_type: pa.DataType, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        matcher = Matcher(asked)
        for batch in batches:
            rows, places, found = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                total = matcher.counts(text or "")
                own = np.flatnonzero(total)
                rows.append(np.full(len(own), r))
                places.append(own)
                found.append(total[own])
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at).cast(key_type), pa.array(ids, id_type).take(pa.array(np.concatenate(places))),
                     pa.array(np.concatenate(found))], names=["key", "query_id", "matches"])

    return run


def matches(texts: DataFrame, asked: DataFrame, key: str, text: str, group: int = GROUP) -> DataFrame:
    """(``key``, query_id, matches): the weight of a query's terms that occur in a text, where it is positive.

    ``asked`` holds (query_id, term, weight), a term once for each query; null and empty terms match nothing.
    """
    spark = texts.sparkSession
    asked = asked.where(F.length("term") > 0)
    groups = max(1, -(-asked.select("query_id").distinct().count() // group))
    asked = asked.withColumn("_g", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    id_type, key_type = asked.schema["query_id"].dataType, texts.schema[key].dataType
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {key_type.simpleString()}, query_id {id_type.simpleString()}, matches long"
    found = spark.createDataFrame([], schema)
    for g in range(groups):
        own = asked.where(F.col("_g") == g).groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).collect()
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in own],
                                             [(i, t["term"], t["weight"]) for i, r in enumerate(own) for t in r["terms"]]))
        found = found.union(rows.mapInArrow(_matched(sent, to_arrow_type(key_type), to_arrow_type(id_type)), schema))
    return found.withColumnRenamed("key", key)


def match_counts(texts: DataFrame, terms: DataFrame, key: str, text: str, group: int = TERM_GROUP) -> DataFrame:
    """(``key``, matches): how many of the distinct ``terms`` (term) occur in each text that holds any."""
    distinct = terms.select("term").distinct()
    parts = max(1, -(-distinct.count() // group))
    asked = distinct.select(F.pmod(F.xxhash64("term"), F.lit(parts)).alias("query_id"), "term", F.lit(1).alias("weight"))
    return matches(texts, asked, key, text, 1).groupBy(key).agg(F.sum("matches").alias("matches"))

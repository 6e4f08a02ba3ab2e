"""Counterexamples to earlier answers."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import queries as Q
from vellum.operators import context as Cx
from vellum.operators import extractive as Ex


@pytest.mark.parametrize(("text", "expected"), [
    ("what won the league last year", False), ("tell me the latest playoffs", False),
    ("tell me the news", True), ("what happened today", True), ("who is the oldest son", True)])
def test_web_fallback_uses_its_own_lists(spark, text, expected):
    df = spark.createDataFrame([(text,)], "query string")
    assert df.select(Q.is_external_fact_for_web(F.col("query"))).first()[0] is expected


def test_one_chunk_survives_once_whatever_its_provenance(spark):
    hits = spark.createDataFrame([(1, 7, 1, "a", 2), (1, 7, 2, "b", 1), (1, 8, 1, "a", 3), (2, 7, 1, "a", 1)],
                                 "query_id int, chunk_id int, doc_id int, source_name string, position int")
    got = sorted((r.query_id, r.chunk_id, r.doc_id) for r in Cx.drop_repeated(hits).collect())
    assert got == [(1, 7, 2), (1, 8, 1), (2, 7, 1)]


def test_a_border_80_characters_before_the_term_counts(spark):
    text = "x" * 20 + " " + "y" * 79 + "term tail."
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(Ex.passage_around(F.col("text"), F.lit("term"))).first()[0] == "y" * 79 + "term tail."


def test_a_web_row_is_forced_and_leads(spark):
    """Where no web row was chosen the best-placed one replaces the last; the best web score comes first."""
    rows = [(1, f"c{i}", "internet" if i in (4, 6) else "pdf", 1.0 - i / 10, i + 1) for i in range(8)]
    rows += [(2, f"c{i}", "internet" if i in (1, 2) else "pdf", (0.9, 0.5, 0.7, 0.6)[i], i + 1) for i in range(4)]
    rows += [(3, "c0", "pdf", 0.5, 1)]
    ranked = spark.createDataFrame(rows, "query_id int, chunk_id string, source_type string, score double, authority_rank long")
    chosen = ranked.where("authority_rank <= 3").withColumn("selected_rank", F.col("authority_rank")).withColumn("diversified", F.lit(False))
    got = {}
    for r in Cx.with_web_lead(chosen, ranked, 3).orderBy("query_id", "selected_rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: ["c4", "c0", "c1"], 2: ["c2", "c0", "c1"], 3: ["c0"]}

"""Terms in texts by automaton against plain ``in``."""

import random

import pytest

from vellum.operators import containment


@pytest.mark.parametrize("group", [256, 2])
def test_matches(spark, group):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("abcé ", k=rng.randint(0, 60)))) for i in range(200)] + [(500, None), (None, "abc"), (7, "abc")]
    asked = {f"q{i}": {"".join(rng.choices("abcé ", k=rng.randint(1, 4))): rng.randint(1, 3) for _ in range(8)} for i in range(9)}
    rows = [(q, t, w) for q, terms in asked.items() for t, w in terms.items()] + [("q0", "", 1), ("q1", None, 1), ("q9", "zzz", 1)]
    df = spark.createDataFrame(texts, "id long, body string").repartition(3)
    got = containment.matches(df, spark.createDataFrame(rows, "query_id string, term string, weight int"), "id", "body", group)
    want = sorted(((i, q, sum(w for t, w in terms.items() if t in (text or ""))) for i, text in texts for q, terms in asked.items()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == [x for x in want if x[2]]


@pytest.mark.parametrize("group", [20_000, 3])
def test_match_counts(spark, group):
    texts = [(1, "alpha beta"), (2, "alphabet"), (3, ""), (4, None)]
    terms = spark.createDataFrame([(t,) for t in ("alpha", "alpha", "bet", "a", "x", "beta")], "term string")
    df = spark.createDataFrame(texts, "id long, body string")
    got = containment.match_counts(df, terms, "id", "body", group).collect()
    assert {r.id: r.matches for r in got} == {1: 4, 2: 3}
    assert containment.match_counts(df, terms.limit(0), "id", "body").count() == 0

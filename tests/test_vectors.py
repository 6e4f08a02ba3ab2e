"""Vector search against plain cosines, odd vectors included."""

import math
import random

import pytest

from vellum.operators import vectors

ROWS = "chunk_id long, embedding array<double>"
ASKED = "query_id string, vector array<double>, second array<double>"


def cosine(a, b):
    if not a or not b or len(a) != len(b) or not any(a) or not any(b):
        return -1.0
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def data(n=150):
    rng = random.Random(8)
    vec = lambda d=4: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(d)]
    rows = [(i, rng.choice([vec(), vec(), vec(), vec(3), [0.0] * 4, [], None])) for i in range(n)]
    return rows, [(f"q{i}", rng.choice([vec(), vec(), vec(3), [0.0] * 4, None]), vec()) for i in range(17)]


@pytest.mark.parametrize("block, blend, k", [(128, 1.0, 5), (3, 0.6, 5), (3, 1.0, 200)])
def test_top_k(spark, monkeypatch, block, blend, k):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rows, asked = data()
    got = vectors.top_k(spark.createDataFrame(rows, ROWS).repartition(4), spark.createDataFrame(asked, ASKED), k, blend).collect()
    want = {}
    for q, v, w in asked:
        scored = sorted(((-round(blend * cosine(v, e) + (1 - blend) * (cosine(w, e) if blend < 1 else 0), 6), i) for i, e in rows))
        want |= {(q, r): (i, pytest.approx(-s, abs=2e-6)) for r, (s, i) in enumerate(scored[:k], 1)}
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in got} == want


def test_all_scores_and_no_queries(spark):
    rows, asked = data(40)
    df, q = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED)
    got = {(r.chunk_id, r.query_id): r.score for r in vectors.all_scores(df, q, "chunk_id").collect()}
    assert got == {(i, n): pytest.approx(cosine(v, e), abs=1e-6) for i, e in rows for n, v, _ in asked}
    assert vectors.top_k(df, q.limit(0), 3).count() == 0 and vectors.all_scores(df, q.limit(0), "chunk_id").count() == 0

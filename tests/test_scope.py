"""Document scope by title words against every pair counted in full."""

import collections
import itertools

from vellum.operators import routing as Ro

NAMES = ("red bolt", "hot iron plate", "red gear", "new iron rod gear", "bolt", "cold anvil")


def brute(queries, titles):
    """{(query_id, doc_id): score}; repeated rows count as often as they occur."""
    met, n = collections.Counter(), {}
    for (q, a), (d, b) in itertools.product(queries, titles):
        a, b = set(a.split()), set(b.split())
        if q is not None and len(a) >= 2 and a & b:
            met[q, d] += len(a & b)
            n[q, d] = max(n.get((q, d), 0), len(a))
    score = {k: c / n[k] for k, c in met.items() if c / n[k] >= 0.5}
    best = {}
    for (q, _), s in score.items():
        best[q] = max(s, best.get(q, 0))
    return {k: s for k, s in score.items() if s >= best[k[0]] - 0.1 - 1e-12}


def frames(spark, queries, titles):
    return (spark.createDataFrame([(q, f"According to {t} book, what holds?") for q, t in queries], "query_id long, query string"),
            spark.createDataFrame(titles, "doc_id long, title string"))


def test_scope_of_repeated_and_null_ids(spark):
    queries = [(i % 20, NAMES[i % 6]) for i in range(26)] + [(40, NAMES[0])] * 2 + [(None, NAMES[1])]
    titles = [(i % 30, NAMES[(i * 5 + i // 6) % 6]) for i in range(37)] + [(50, NAMES[2])] * 3 + [(None, NAMES[0]), (None, NAMES[3])]
    got = Ro.scoped_documents(*frames(spark, queries, titles)).collect()
    assert {(r.query_id, r.doc_id): r.score for r in got} == brute(queries, titles) and len(got) == len(brute(queries, titles))


def test_equal_titles_meet_once(spark, monkeypatch):
    """Words are joined for distinct sets, however many ids have them."""
    joined, overlaps = [], Ro._overlaps
    monkeypatch.setattr(Ro, "_overlaps", lambda q, t, *ids: joined.append(q.count() * t.count()) or overlaps(q, t, *ids))
    queries, titles = [(i, NAMES[i % 4]) for i in range(60)], [(i, NAMES[i % 6]) for i in range(300)]
    got = Ro.scoped_documents(*frames(spark, queries, titles)).collect()
    assert {(r.query_id, r.doc_id): r.score for r in got} == brute(queries, titles) and sum(joined) == 4 * 6

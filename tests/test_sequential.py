"""Order-dependent operators against direct loops."""

import random

from vellum.operators import context, extraction as X, ranking

WORDS = [f"word{i}" for i in range(14)]


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def text(rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(3, 9)))


def test_novelty_order(spark):
    rnd = random.Random(1)
    rows = [(q, c, round(rnd.random(), 6), text(rnd)) for q in range(3) for c in range(20)]
    got = ranking.novelty_order(spark.createDataFrame(rows, "query_id int, chunk_id int, score double, text string"), 0.3, 8).collect()
    for q in range(3):
        left = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        picked = []
        while left and len(picked) < 8:
            best = max(left, key=lambda r: r[2] - 0.3 * max((jac(set(r[3].split()), set(p[3].split())) for p in picked), default=0))
            picked.append(best)
            left.remove(best)
        want = [r[1] for r in picked + left]
        assert [r.chunk_id for r in sorted((g for g in got if g.query_id == q), key=lambda g: g.position)] == want


def test_near_duplicates_only_within_a_document(spark):
    rows = [(1, i, d, i, t) for i, (d, t) in enumerate([("a", "x y z"), ("b", "x y z"), ("a", "x y z"), ("a", "x y q"), ("a", "")])]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, doc_id string, position int, text string")
    assert {r.chunk_id for r in context.drop_near_duplicates(df).collect()} == {0, 1, 3, 4}


def items(rnd, branches=3, n=25):
    out = []
    for b in range(branches):
        out += [(b, f"b{b}", b * 1000 + i, i, i, rnd.choice([1.0, 1.0, 1.5, 0.5]), text(rnd)) for i in range(n)]
    return out


SCHEMA = "branch_ord int, branch_name string, chunk_id int, pool_rank int, item_ord int, priority_weight double, text string"


def test_branch_dedup_replaces_by_priority(spark):
    rows = items(random.Random(2))
    got = X.dedup_items(spark.createDataFrame(rows, SCHEMA).drop("item_ord"), 0.6).collect()
    for b in range(3):
        slots = []
        for r in (r for r in rows if r[0] == b):
            for i, s in enumerate(slots):
                if jac(set(r[6].split()), set(s[6].split())) >= 0.6:
                    if r[5] > s[5]:
                        slots[i] = r
                    break
            else:
                slots.append(r)
        mine = sorted((g for g in got if g.branch_ord == b), key=lambda g: g.item_ord)
        assert [g.chunk_id for g in mine] == [s[2] for s in slots]


def test_cross_branch_overrides(spark):
    rows = items(random.Random(3))
    got = {(r.loser_branch, r.loser_chunk) for r in X.dedup_cross_branch(spark.createDataFrame(rows, SCHEMA), 0.7).collect()}
    gone = set()
    for i, a in enumerate(rows):
        if (a[1], a[2]) in gone:
            continue
        for b in rows[i + 1:]:
            if b[0] == a[0] or (b[1], b[2]) in gone or jac(set(a[6].split()), set(b[6].split())) < 0.7:
                continue
            if b[5] > a[5]:
                gone.add((a[1], a[2]))
                break
            gone.add((b[1], b[2]))
    assert got == gone


def test_fusion_ignores_list_order(spark):
    rows = [(1, l, c, r, 0.5) for l in "ab" for r, c in enumerate([3, 1, 2] if l == "a" else [2, 3, 9], 1)]
    schema = "query_id int, list_id string, chunk_id int, rank int, score double"
    a = {(r.chunk_id, r.rrf_score) for r in ranking.reciprocal_rank_fusion(spark.createDataFrame(rows, schema)).collect()}
    b = {(r.chunk_id, r.rrf_score) for r in ranking.reciprocal_rank_fusion(spark.createDataFrame(rows[::-1], schema)).collect()}
    assert a == b and dict(a)[3] == round(1 / 61 + 1 / 62, 6)

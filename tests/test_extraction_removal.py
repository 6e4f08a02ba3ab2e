"""Removal of alike items within and across branches against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import extraction as X
from vellum.operators import prefix


def jac(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a | b else 1.0


def items(seed):
    """A third of a branch are near copies, some exact, some empty; three priorities."""
    rng, rows = random.Random(seed), []
    for branch, n in ((0, 60), (1, 40), (3, 25)):
        for rank in range(1, n + 1):
            words = [f"h{i}" for i in range(12) if rng.random() > 0.1] if rng.random() < 0.4 else [f"v{rng.randrange(9)}" for _ in range(rng.randrange(5))]
            rows.append((branch, f"b{branch}", f"c{rng.randrange(10**6)}", rank, rng.choice([1.0, 1.0, 1.5, 0.75]), " ".join(words)))
    return rows


def survivors(rows, threshold, order, between):
    kept = []
    for r in sorted(rows, key=order):
        if not any(between(r, k) and jac(r[5], k[5]) >= threshold for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_items(spark, seed):
    rows = items(seed)
    df = spark.createDataFrame(rows, "branch_ord int, branch_name string, chunk_id string, pool_rank long, priority_weight double, text string")
    kept = X.dedup_items(df, 0.7)
    want = survivors(rows, 0.7, lambda r: (r[0], -r[4], r[3]), lambda a, b: a[0] == b[0])
    got = {(r.branch_ord, r.chunk_id): r.item_ord for r in kept.collect()}
    places = {}
    for r in sorted(want, key=lambda r: (r[0], r[3])):
        places[r[0], r[2]] = 1 + sum(k[0] == r[0] for k in places)
    assert got == places
    placed = [(b, f"b{b}", c, n, p, t) for b, _, c, _, p, t in want for n in [places[b, c]]]
    lost = X.dedup_cross_branch(kept, 0.6).collect()
    order = lambda r: (-r[4], r[0], r[3])
    left = survivors(placed, 0.6, order, lambda a, b: a[0] != b[0])
    found = {}
    for r in placed:
        if r not in left:
            w = min((k for k in left if k[0] != r[0] and jac(k[5], r[5]) >= 0.6), key=order)
            found[r[1], r[2]] = (w[1], w[2], pytest.approx(jac(w[5], r[5]), abs=6e-4), w[4])
    assert {(r.loser_branch, r.loser_chunk): (r.winner_branch, r.winner_chunk, r.similarity, r.winner_priority) for r in lost} == found
    assert len(lost) == len(found) > 0


def test_nothing_to_remove(spark):
    df = spark.createDataFrame([], "branch_ord int, branch_name string, chunk_id long, pool_rank long, priority_weight double, text string")
    assert X.dedup_items(df).count() == 0 and X.dedup_cross_branch(df.withColumn("item_ord", F.lit(1))).count() == 0


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.choice([1.0, 1.0, 0.5, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, s double, i int").repartition(5)
    got = {r.i: r.n for r in prefix.ranked(df, ["k"], [F.desc("s"), F.col("i")], "n").collect()}
    seen = {}
    for k, s, i in sorted(rows, key=lambda r: (r[0], -(r[1] or 0.0), r[2])):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]
    whole = prefix.ranked(df, [], [F.col("i")], "n")
    assert all(r.n == r.i + 1 for r in whole.collect())


def test_pools_of_hits(spark):
    """Filter, boost, priority, fallback and order of retrieved chunks, branch by branch."""
    branches = (X.Branch("Key", ("alpha", "beta"), priorities=(("s1", 2.0), ("s", 0.5))), X.Branch("Off", ("x",), enabled=False),
                X.Branch("Topic", ("gamma",), mode="semantic", topic="rivers"), X.Branch("Plain", mode="semantic"))
    assert [tuple(r) for r in X.branch_queries(spark, branches).collect()] == [(0, "alpha beta"), (2, "rivers"), (3, "Plain")]
    texts = ["alpha beta", "ALPHA " * 30, "gamma only", "Table of contents alpha", "Contents"]
    rows = [(q, q * 10 + c, s, t, f"s{c % 3}", 1) for q in (0, 2) for c, (t, s) in enumerate(zip(texts, (0.5, 0.7, 0.9, 0.95, 0.1)))]
    rows += [(3, 30, 0.3, "Contents", "s1", 1)]  # administrative, but the branch has nothing else
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, text string, source_name string, page_start int")
    got = [(r.branch_name, r.chunk_id, r.score, r.pool_rank) for r in X.pools_of_hits(hits, branches).orderBy("branch_ord", "pool_rank").collect()]
    assert got == [("Key", 1, 1.5, 1), ("Key", 0, 0.3, 2), ("Topic", 22, 0.9, 1), ("Topic", 21, 0.7, 2), ("Topic", 20, 0.5, 3), ("Plain", 30, 0.3, 1)]


def test_branch_retrieval(spark):
    """Keyword branches hold only chunks with a keyword, the best first; topics find chunks without one."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["branch_retrieval"](spark, sf).collect()
    by_branch = {}
    for r in sorted(rows, key=lambda r: r.pool_rank):
        by_branch.setdefault(r.branch_name, []).append(r)
    assert {"Safety", "Topics", "Mentions"} <= by_branch.keys() and "Unused" not in by_branch
    for name, own in by_branch.items():
        assert [r.pool_rank for r in own] == list(range(1, len(own) + 1)) and len(own) <= 50
        assert all(a.score >= b.score for a, b in zip(own, own[1:]))
    assert all(any(k in texts[r.chunk_id] for k in ("onenth", "password", "erblees")) and r.matches for r in by_branch["Safety"])
    assert len(by_branch["Topics"]) > 40 and not any(r.matches for r in by_branch["Topics"])


def test_category_summaries(spark):
    """Every line of a category reaches its summary through the layers, and every category the executive one."""
    from vellum.plans import extract

    rows = [((b, i), name, f"[L{b}-{i:03d}] evidence {'x' * 40}") for b, name in enumerate(("Safety", "SITE ", "other")) for i in range(60)]
    lines = spark.createDataFrame(rows, "pos struct<b:int, i:int>, branch_name string, line string").repartition(4)
    marks = lambda ps: F.array_join(F.flatten(F.transform(ps, lambda p: F.regexp_extract_all(p, F.lit(r"\[L\S+\]"), F.lit(0)))), " ")
    got = {r.category: r.summary for r in extract.category_summaries(lines, ("Safety", "Site", "None"), marks, 900).collect()}
    want = {c: [f"[L{b}-{i:03d}]" for i in range(60)] for b, c in enumerate(("Safety", "Site"))}
    assert {c: s.split() for c, s in got.items() if c} == want
    assert got[None].split() == want["Safety"] + want["Site"]


def test_pools_are_cut_in_parts(spark):
    """The last cut of a branch reads a bounded number of rows, and the pool is that of one ordering."""
    rows = spark.range(0, 4000, 1, 40).selectExpr("id AS chunk_id", "int(id % 2) AS branch_ord", "double(pmod(hash(id), 50)) AS score", "id % 7 AS other")
    got = X.ranked_pool(rows, 20)
    want = {(b, i): n for b in (0, 1) for n, i in enumerate(
        [r.chunk_id for r in sorted(rows.where(f"branch_ord = {b}").collect(), key=lambda r: (-r.score, r.chunk_id))][:20], 1)}
    assert {(r.branch_ord, r.chunk_id): r.pool_rank for r in got.collect()} == want and got.columns == [*rows.columns, "pool_rank"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2


def test_kept_branches_move_no_text(spark):
    rows = spark.createDataFrame([(0, "a", True), (0, "b", False), (1, "c", False)], "branch_ord int, text string, k boolean")
    got = X.unless_all_dropped(rows, rows.k)
    assert {(r.branch_ord, r.text) for r in got.collect()} == {(0, "a"), (1, "c")}
    assert "BroadcastHashJoin" in got._jdf.queryExecution().sparkPlan().toString()


def test_stored_rows_are_classified_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def keep(i):
        seen.add(1)
        return i % 2 == 0

    rows = spark.range(10).select(F.col("id").alias("i"), (F.col("id") % 2).alias("branch_ord"))
    left = X.unless_all_dropped(rows, keep("i"), stored=True)
    assert sorted(r.i for r in left.collect()) == list(range(10)) and left.count() == 10
    assert seen.value == 10


def test_whole_pools_rank_numbers_not_texts(spark):
    rng = random.Random(5)
    rows = [(b, rng.choice([0.5, 0.7, None]), rng.choice([1, 2, None]), rng.choice(["t", None])) for b in (0, 1, 1, 3) * 20]
    got = X.ranked_pool(spark.createDataFrame(rows, "branch_ord int, score double, chunk_id long, text string"), None).collect()
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, rows))
    for b in (0, 1, 3):
        own = sorted((r for r in got if r.branch_ord == b), key=lambda r: r.pool_rank)
        assert [r.pool_rank for r in own] == list(range(1, len(own) + 1))
        key = [(-(r.score if r.score is not None else -1), -1 if r.chunk_id is None else r.chunk_id) for r in own]
        assert key == sorted(key)

"""Packing, windows, segments and merging."""

import random

from pyspark.sql import functions as F

from vellum.functions import windows
from vellum.operators import chunking, folds, prefix


def test_batches_never_exceed_the_budget_unless_single(spark):
    rnd = random.Random(7)
    costs = [[rnd.randrange(1, 40) for _ in range(rnd.randrange(0, 30))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "i int, c array<bigint>")
    for r in df.select("i", folds.batch_numbers(F.col("c"), 50).alias("b")).collect():
        c, used, batch, want = costs[r.i], 0, 1, []
        for x in c:
            if want and used + x > 50:
                batch, used = batch + 1, 0
            used += x
            want.append(batch)
        assert list(r.b) == want


def test_paragraph_segments_keep_every_word(spark):
    rnd = random.Random(8)
    texts = []
    for _ in range(25):
        paras = [" ".join("w%d%s" % (rnd.randrange(99), "." if rnd.random() < 0.2 else "") for _ in range(rnd.randrange(1, 120)))
                 for _ in range(rnd.randrange(1, 6))]
        texts.append("\n\n".join(paras))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", chunking.paragraph_segments(F.col("t"), 60).alias("s")).collect():
        assert " ".join(r.s).split() == texts[r.i].split()


def test_merge_stays_in_section_and_under_the_limit(spark):
    rows = [("d", i, f"d-c{i:06d}", f"s{i // 3}", f"t{i}", tok, 1, i, i) for i, tok in enumerate([5, 60, 5, 500, 30, 10, 20, 600])]
    df = spark.createDataFrame(rows, "doc_id string, idx int, chunk_id string, section_id string, text string, "
                                     "token_count_est int, word_count int, page_start int, page_end int")
    out = {r.chunk_id: r for r in chunking.merge_small(df, 20, 520).collect()}
    assert out["d-c000000"].text == "t0\n\nt1\n\nt2" and out["d-c000000"].page_end == 2
    assert out["d-c000003"].token_count_est == 500
    assert out["d-c000004"].token_count_est == 40 and out["d-c000004"].page_end == 5
    assert sum(r.token_count_est for r in out.values()) == sum(r[5] for r in rows)
    assert "d-c000006" in out and "d-c000007" in out


def test_windows_cover_the_text():
    rnd = random.Random(9)
    text = " ".join("word%d%s" % (rnd.randrange(1000), "." if rnd.random() < 0.1 else "") for _ in range(900))
    parts = windows.cut_windows(text, 900, 160, 320)
    assert all(len(p) <= 900 and p in text for p in parts)
    assert text.startswith(parts[0]) and text.endswith(parts[-1])
    pos = [text.find(p) for p in parts]
    assert all(b <= a + len(p) + 1 for a, b, p in zip(pos, pos[1:], parts))


def test_row_numbers_match_a_plain_window(spark):
    rnd = random.Random(10)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randrange(200), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r.i: r.n for r in prefix.row_numbers(df, ["k"], [F.col("v"), F.col("i")], F.floor(F.col("v") / 10), "n").collect()}
    seen = {}
    for k, v, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]

"""The stored index against every score computed in full."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from vellum.operators import lexical, postings
from vellum.session import ensure_checkpoint_dir

SCHEMA = "chunk_id long, text string, title string, path_text string"


def corpus(n, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"term{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i * 7, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))), rng.choice([None, "term5 title"]),
             rng.choice([None, "path", ""])) for i in range(n)]
    return rows + [(10**6 + i, "term3 term4 term250", None, None) for i in range(40)] + [(5, None, None, None)]


def brute(rows, queries, k):
    docs = {i: [w for w in f"{t or ''} {' '.join([title or ''] * 5)} {path or ''}".lower().split()] for i, t, title, path in rows}
    docs = {i: [w for w in ws if len(w) > 1] for i, ws in docs.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = collections.Counter(w for ws in docs.values() for w in set(ws))
    raw = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, terms in queries.items():
        got = {}
        for i, ws in docs.items():
            tf = collections.Counter(ws)
            if tf.keys() & terms:
                got[i] = sum((raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))
                             for w in sorted(terms & tf.keys()))
        ranked = sorted(got.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out |= {(q, r): (i, pytest.approx(s, abs=2e-6)) for r, (i, s) in enumerate(ranked, 1)}
    return out


QUERIES = {1: {"term1", "term200"}, 2: {"term3", "term4", "term250"}, 3: {"nothing"}, 4: {"title", "term0"},
           5: {f"term{i}" for i in range(0, 300, 9)}, 6: {"term299"}}


@pytest.mark.parametrize("slot_chunks, group", [(20_000, 128), (50, 2)])
def test_against_all_scores(spark, tmp_path, slot_chunks, group):
    rows = corpus(800)
    index = postings.build(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "index"), slot_chunks=slot_chunks)
    asked = spark.createDataFrame([(q, t) for q, ts in QUERIES.items() for t in ts] * 2, "query_id long, term string")
    got = postings.search(index, asked, 7, group).collect()
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.bm25) for r in got} == brute(rows, QUERIES, 7)


def test_string_ids_and_empty_tables(spark, tmp_path):
    rows = [("b", "x yy zz", None, None), ("a", "x yy zz", None, None), ("ä", "yy", None, None),
            *((f"f{i}", f"other{i} words", None, None) for i in range(20))]
    schema = SCHEMA.replace("long", "string")
    index = postings.build(spark.createDataFrame(rows, schema), str(tmp_path / "s"))
    asked = spark.createDataFrame([("q", "yy"), ("q", "zz")], "query_id string, term string")
    assert [r.chunk_id for r in postings.search(index, asked, 2).orderBy("rank").collect()] == ["a", "b"]
    assert postings.search(index, asked.limit(0), 2).count() == 0
    none = postings.build(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert postings.search(none, asked, 2).count() == 0


def test_blocks_below_the_kth_score_are_not_read(spark, tmp_path, monkeypatch):
    """A rare term lifts a few blocks: most postings of the common terms stay unread."""
    monkeypatch.setattr(postings, "SMALL_SLOT", 8000)
    rows = [(i, "common " * (1 + i % 5) + "filler " * (i // 50) + ("rare rare" if i % 400 == 0 else ""), None, None) for i in range(8000)]
    index = postings.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "skip"), slot_chunks=8000)
    assert index.stats.first()["slots"] == 1
    table = index.postings.where("slot = 0").toArrow()
    lists = postings._Lists(table.select(["term", "chunk_ids", "numbers", "gains", "blocks", "maxima", "ends"]).combine_chunks())
    idf = {r.term: r.idf for r in index.terms.collect()}
    numbers, scores, read = lists.best([(t, idf[t]) for t in ("common", "rare")], 2)
    total = sum(len(lists.by_term[t][0]) for t in ("common", "rare"))
    assert read < 0.4 * total
    numbers, gains, blocks, maxima, ends = lists.by_term["common"]
    assert np.array_equal(blocks, np.unique(numbers // postings.BLOCK)) and ends[-1] == len(numbers)
    assert all(gains[a:b].max() == m for a, b, m in zip([0, *ends[:-1]], ends, maxima))


def test_changed_corpus_gets_its_own_index(spark, tmp_path):
    rows, folder = corpus(50), str(tmp_path)
    first = postings.stored(spark.createDataFrame(rows, SCHEMA), folder, "c")
    again = postings.stored(spark.createDataFrame(rows[::-1], SCHEMA), folder, "c")
    other = postings.stored(spark.createDataFrame([*rows[:-1], (5, "new", None, None)], SCHEMA), folder, "c")
    assert first.postings.inputFiles() == again.postings.inputFiles() != other.postings.inputFiles()
    assert ensure_checkpoint_dir(spark)


def test_slots_of_long_texts_hold_few_tokens(spark, tmp_path, monkeypatch):
    """However long the chunks are, a slot holds about as many tokens."""
    monkeypatch.setattr(postings, "SMALL_SLOT", 10_000)
    rows = [(i, " ".join(f"w{(i * 31 + j) % 997}" for j in range(2000)), None, None) for i in range(64)]
    index = postings.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "long"), slot_tokens=8_000)
    assert index.stats.first()["slots"] == 16
    asked = spark.createDataFrame([(1, "w5"), (1, "w900")], "query_id long, term string")
    got = postings.search(index, asked, 5).collect()
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.bm25) for r in got} == brute(rows, {1: {"w5", "w900"}}, 5)

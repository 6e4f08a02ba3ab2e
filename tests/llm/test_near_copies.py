"""The pipeline's near-copy stage against brute force on planted near copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_operators import SF, hard, lower, words_of  # noqa: F401
from vellum.llm import near_copies
from vellum.llm.shared import table


def brute_kept(texts):
    """Least id of each component over pairs with a 5-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = words_of(lower(t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or {tuple(w)} - {()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in texts}


def planted():
    """Copies edited in one to four places, a crowd of them, and passages inside other texts."""
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(4000)]
    texts = []

    def edited(words, places):
        words = list(words)
        for at in rng.sample(range(len(words)), places):
            words[at] = rng.choice(plain)
        return words

    for _ in range(40):
        own = rng.choices(plain, k=rng.randrange(3, 300))
        texts += [own, *(edited(own, min(k, len(own))) for k in (1, 2, 4)), [*own, *rng.choices(plain, k=len(own))]]
    base = rng.choices(plain, k=100)
    texts += [edited(base, 1 + i % 3) for i in range(150)]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("crowd, exact", [(near_copies.CROWD, False), (2, True)])
def test_planted_near_copies(spark, monkeypatch, crowd, exact):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in near_copies.keep_one(docs, exact=exact).collect()]
    assert sorted(got) == sorted(brute_kept(texts))


def crowds():
    """Three templates of 400 words in 250 copies each, edited by 0 to 30 places; a third are copies of copies."""
    rng = random.Random(21)
    plain, texts = [f"w{i}" for i in range(4000)], []
    for _ in range(3):
        made = [rng.choices(plain, k=400)]
        for i in range(250):
            words = list(rng.choice(made[1:]) if i % 3 == 2 else made[0])
            for at in rng.sample(range(400), rng.randrange(31 if i % 3 < 2 else 12)):
                words[at] = rng.choice(plain)
            made.append(words)
        texts += made
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_crowds_lose_few_links(spark):
    """Of the documents that brute force removes, at least 0.9 go; none goes that brute force keeps."""
    texts = crowds()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want, kept = brute_kept(texts), {}
    for exact in (False, True):
        kept[exact] = {r.doc_id for r in near_copies.keep_one(docs, exact=exact).collect()}
        assert want <= kept[exact]
    recall = (len(texts) - len(kept[False])) / (len(texts) - len(want))
    print("removed by brute force", len(texts) - len(want), "recall", recall)
    assert kept[True] == want and recall >= 0.9


def test_similarity_of_exactly_four_fifths_links(spark):
    words = [f"a{i}" for i in range(13)]
    texts = {1: " ".join(words[:12]), 2: " ".join(words[:12] + ["x", "y"]), 3: " ".join(words[:12] + ["x", "y", "z"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")  # 8, 10 and 11 shingles
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {1} == brute_kept(texts)
    assert {r.doc_id for r in near_copies.keep_one(docs.where("doc_id <> 2")).collect()} == {1, 3}


def test_near_copies_hard(hard):  # noqa: F811
    kept = near_copies.keep_one(hard)
    assert kept.columns == hard.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.select("doc_id", "text").collect() if r.doc_id is not None)
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    assert [int(i) for i, _ in got] == sorted(brute_kept(texts), key=str)
    assert kept.where("doc_id IS NULL").count() == 2 and near_copies.keep_one(hard.limit(0)).count() == 0
    assert sorted(map(str, near_copies.keep_one(hard, block_chars=1).collect())) == sorted(map(str, kept.collect()))


def test_keys_miss_no_close_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        words = [f"v{i}" for i in rng.integers(0, 10**6, 104)]
        other = words[:92] + [f"u{i}" for i in rng.integers(0, 10**6, 12)]  # 88 of 112 shingles: 0.79
        a, b = near_copies.marks(" ".join(words)), near_copies.marks(" ".join(other))
        assert len(np.intersect1d(a[2:], b[2:]))


def test_pipeline_leaves_no_near_copy(spark):
    docs = table(spark, SF, "documents")
    for _, run in corpus_pipeline.STAGES[:2]:
        docs = run(spark, docs, SF)
    want = brute_kept({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_fingerprints_give_candidates(spark, tmp_path):
    """Nodes up to two bits apart are candidates without a common key, unless their sizes rule it out."""
    nodes = [(1, 10, 0), (2, 10, 1), (3, 10, 7), (4, 10, 7), (5, 40, 3), (6, 11, 1 << 40)]
    got = near_copies.close_prints(spark.createDataFrame(nodes, "fp long, size long, print long"), str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(1, 2), (2, 3), (2, 4), (3, 4), (1, 6), (2, 6)}


def test_marks_hold_the_fingerprint():
    text = " ".join(f"w{i % 11}" for i in range(60))
    own = near_copies.shingles(text).tolist()
    bits = [sum(h >> i & 1 for h in own) * 2 > len(own) for i in range(64)]
    assert int(near_copies.marks(text)[-1:].view(np.uint64)[0]) == sum(b << i for i, b in enumerate(bits))
    assert len(near_copies.marks(" ")) == 2 and len(near_copies.marks(text)) == 3 + near_copies.BANDS


def test_a_crowd_without_centre_loses_no_link(spark, tmp_path):
    """Sixty pairs of alike texts in the same 32 keys, no two pairs alike: every pair is linked."""
    rng, texts = random.Random(4), []
    for _ in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join([*own, *more]) for more in ([], ["end"])]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_pydict({"doc_id": list(range(120)), "text": texts}, schema))
    blocks = spark.createDataFrame([(0, sink.getvalue().to_pybytes())], "block long, body binary")
    marks = [[i, 56 + i % 2, *range(near_copies.BANDS), rng.getrandbits(62)] for i in range(120)]
    rows = spark.createDataFrame([(i, m, 0, i) for i, m in enumerate(marks)], "fp long, marks array<long>, block long, place int")
    got = near_copies.similar_pairs(rows, blocks, 1, 5, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(i, i + 1) for i in range(0, 120, 2)}

"""Training-text operators against brute force, the public libraries and hard inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from vellum.llm import (components, fertility, main_text, mixing_lm, ordinal, packing, queries, simhash, suffix_pieces,
                        threshold_topk, token_counts, warc)
from vellum.llm.shared import vocabulary_path, work_folder

SF = "/root/testdata/sf0.001"
#: Columns beside the operators' own that bear names used inside them.
CLASHING = ("fp", "component_id", "block", "slot", "term", "score", "kept", "ids", "rank", "key", "html2", "n")
TEXTS = [None, "", " \t\n", "one", "one two", "the cat sat on the mat " * 3, "THE Cat sat on the mat",
         "don't <|endoftext|> stop", "日本語 テキスト", "Ünï ςΣ İx", "a|b\na|b\n\nx # $", "word " * 6000,
         "x" * 20000]


@pytest.fixture(scope="module")
def hard(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), *(F.lit(7).alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_fingerprint(text, n=3):
    words = words_of(lower(text))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id reachable over links of two bits or fewer."""
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_simhash(spark, documents):
    prints = {k: brute_fingerprint(t) for k, t in documents.items()}
    root = brute_components(prints)
    for r in queries.QUERIES["op1_simhash"](spark, SF).collect():
        assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == root[r.doc_id]


def test_simhash_crowds(spark):
    """Fingerprints that share quarters by the hundred keep every link; chains reach their least end."""
    rng = random.Random(5)
    prints = {rng.getrandbits(48) << 16 ^ rng.getrandbits(9) for _ in range(20)}
    base = rng.getrandbits(64)
    for _ in range(300):
        prints.add(base ^ 1 << rng.randrange(16) ^ 1 << rng.randrange(16) ^ 1 << rng.randrange(16) ^ 1 << rng.randrange(16))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.close_pairs(df, work_folder(spark))).collect()}
    want = brute_components({p: p & (1 << 64) - 1 for p in signed})
    assert all(found.get(p, p) == want[p] for p in signed)
    assert len(set(want.values())) < len(signed) - 200


def test_components_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(7, 7), (100, 101), (101, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_keep_one(spark, hard):
    kept = simhash.keep_one(hard)
    assert kept.columns == [*hard.columns] and kept.where("doc_id IS NULL").count() == 2
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 3 in ids
    small = simhash.keep_one(hard, block_chars=1)  # every text in a block of its own
    assert sorted(map(str, small.collect())) == sorted(map(str, kept.collect()))


def test_token_counts_match_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.QUERIES["op3_token_counts"](spark, SF).collect()}
    for k, t in documents.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len(t.encode()), n > 2048)


def test_token_counts_hard(hard):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = sorted((len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
                  for r in hard.collect())
    for size in (10, token_counts.BLOCK_CHARS):  # blocks of one document, and of all
        got = token_counts.token_counts(hard, block_chars=size).collect()
        assert sorted((r.n_bytes, r.n_tokens) for r in got) == want


def check_packed(pieces, wanted):
    """Every id in one piece; sequences gapless, full or of a power of two."""
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, ids in wanted.items():
        rows, at = sorted(docs.pop(k), key=lambda r: r.start), 0
        for r in rows:
            assert (r.start, r.length, r.doc_tokens) == (at, len(r.ids) // 4, len(ids))
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at:at + r.length]
            at += r.length
        assert at == len(ids)
    assert not docs
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, hard):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    unique = hard.where("doc_id IS NOT NULL AND doc_id <> 3")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 50)
    docs = docs.union(unique.select("doc_id", "text"))
    wanted = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    check_packed(packing.pack(docs).collect(), wanted)
    check_packed(packing.pack(docs, pool_tokens=3000).collect(), wanted)
    assert packing.pack(hard).where("doc_id IS NULL AND start = 0").count() == 2


def test_best_fill_is_the_closest_sum():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 90)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * i for s in sums for i in range(k + 1)}
        used = packing.best_fill(sorted(counts), counts, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in used.items())


def test_many_equal_lengths_leave_no_padding():
    packer = packing.Packer(0, 2048)
    for i in range(500):
        packer.add(i, np.full(1500, i, "<u4"))
    packer.drain(0)
    sizes = collections.Counter()
    for r in packer.rows:
        sizes[r[5]] += r[2]
    assert sum(sizes.values()) == 750_000 and all(s & (s - 1) == 0 for s in sizes.values())


ARTICLE = "<h1>Head</h1><p>One &amp; two<br>three <b>four</b></p>"


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain", "plain"),
    (f"<nav><a href=x>menu</a></nav><div class=ad>buy</div><article>{ARTICLE}</article><footer>c</footer>",
     "Head\n\nOne & two\n\nthree four"),
    (f"<article>{ARTICLE}<div id='comments'><p>nice</p></div><aside>more</aside><form>f</form></article>",
     "Head\n\nOne & two\n\nthree four"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- x <p>no</p> --><p>a &lt; b</p>", "a < b"),
    ("<body><div class='cookie-notice'>We use cookies</div><p>Long enough text here</p><div class=sidebar>s</div>",
     "Long enough text here"),
    ("<p>broken <b>tag<p>next", "broken tag\n\nnext"), ("<header>site</header>", ""),
])
def test_main_text(page, want):
    assert main_text.main_text(page) == want


def test_main_text_table(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")],
                               "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in main_text.extract(df).collect())
    assert got == [("1", "x", 1), ("1", "x", 1), ("None", "", 0)]


def test_topk_matches_sql(spark):
    ok, message, _ = compare(queries.QUERIES["op4_exact_topk"](spark, SF).withColumn("rank", F.col("rank")),
                             connect(SF), queries.SQL["op4_exact_topk"])
    assert ok, message


def test_topk_ties_and_hard_rows(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 1.0]), (302, [float("nan"), 1.0, 1.0]), (303, [1.0, 1.0]),
             (None, [1.0, 1.0, 1.0]), (400, [0.0, 0.0, 0.0]), (450, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = collections.defaultdict(list)
    for r in threshold_topk.top_k(df, F.col("vec_id") % 50 == 0, shard=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    sound = {i: v for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and x == x for x in v)}
    for q in (i for i in sound if i % 50 == 0):
        scores = sorted(((-sum(int(256 * a) * int(256 * b) for a, b in zip(sound[q], v)), i)
                         for i, v in sound.items() if i != q))[:5]
        assert got.pop(q) == [(i, -s) for s, i in scores]
    assert not got


def test_topk_sends_nothing_to_the_driver(spark, monkeypatch):
    """Blocks of queries meet the shards without a broadcast, which held every block once for each shard."""
    for name, value in (("QUERIES", 3), ("STRIPE", 2), ("SLOT", 2), ("SLOTS", 2)):
        monkeypatch.setattr(threshold_topk, name, value, raising=False)
    rng = np.random.default_rng(8)
    vectors = rng.integers(-3, 4, (400, 4))
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = threshold_topk.top_k(df.repartition(3), F.col("vec_id") % 20 == 0, k=3, scale=1, shard=30)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    scores = vectors @ vectors.T
    assert got == {q: sorted((-int(scores[q, i]), i) for i in range(400) if i != q)[:3] for q in range(0, 400, 20)}


def test_walk_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-20, 20, (4000, 4))
    vectors[0] = 100
    lists = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
    best, scored = threshold_topk.walk(np.array([9, 9, 9, 9]), vectors, lists, np.arange(4000), -1, 1, None)
    assert best == [(3600, 0)] and scored < 1000


def test_ordinal_regression_separates_and_keeps():
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    texts, grades = [], []
    for i in range(900):
        grade = (0, 1, 2, 2, 2, 2)[i % 6]
        body = rng.sample(plain, 40) + {0: ["vile"], 1: ["spam%%", "|"], 2: []}[grade]
        rng.shuffle(body)
        texts.append(" ".join(body))
        grades.append(grade)
    rows = [np.array(sorted({ordinal.bucket(f) for f in ordinal.features(t)})) for t in texts]
    model = ordinal.fit(rows[:600], np.array(grades[:600]))
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(ordinal.Scorer(model).scores(texts[600:]))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.mean((tails[:, -1] >= 0.5) == (np.array(grades[600:]) == 2)) > 0.98


def test_ordinal_without_grades_keeps_all(spark, hard):
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    model = ordinal.train(hard, ordinal.graded(labels))
    assert ordinal.keep_selected(hard, model).count() == hard.count()
    assert ordinal.score(hard, model).where(ordinal.selected()).count() == hard.count()


def test_classifier_on_given_labels(spark):
    """Held-in check of the query: sound documents stay, marked toxic ones mostly go."""
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_quality_classifier"](spark, sf).join(
        ordinal.graded(spark.read.parquet(f"{sf}/labels.parquet")), "doc_id").groupBy("grade").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.grade: r.kept for r in got}
    assert kept[2] > 0.97 and kept[1] < 0.5


def test_sentencepiece_matches_the_library(spark, hard, documents):
    pieces = suffix_pieces.Pieces(vocabulary_path("piece_bpe_32k.model"))
    rng = random.Random(6)
    odd = ["", " ", "▁", "a▁b", "<s>", "\x00", "a" * 900] + [
        "".join(rng.choice("aAb te\n\t1 ▁éß日①<s>/.") for _ in range(rng.randrange(60))) for _ in range(300)]
    for texts in (odd, [t for t in documents.values()][:60], [t or "" for t in TEXTS]):
        for text, ids in zip(texts, suffix_pieces.encode(texts, pieces)):
            assert ids.tolist() == pieces.library.encode(text)
            assert suffix_pieces.decode(ids.tolist(), pieces) == pieces.library.decode(ids.tolist())
    out = suffix_pieces.decode_documents(suffix_pieces.encode_documents(hard, batch_chars=50))
    assert sorted(r.decoded for r in out.collect()) == sorted(r.text or "" for r in hard.collect())


def test_sentencepiece_matches_new_cuts_only(monkeypatch):
    pieces, seen, matched = suffix_pieces.Pieces(vocabulary_path("piece_bpe_32k.model")), suffix_pieces.Seen(), []
    known = suffix_pieces.encode_cuts
    monkeypatch.setattr(suffix_pieces, "encode_cuts", lambda cuts, p: matched.append(cuts) or known(cuts, p))
    for texts in (["one two", ""], ["two one two", "é日 three"], ["one three"], []):
        for text, ids in zip(texts, suffix_pieces.encode(texts, pieces, seen)):
            assert ids.tolist() == pieces.library.encode(text)
    assert len(matched) == 2 and len({c for cuts in matched for c in cuts}) == sum(map(len, matched))


def test_sentencepiece_decodes_columns():
    pieces = suffix_pieces.Pieces(vocabulary_path("piece_bpe_32k.model"))
    texts = ["one two", "", " é日\x00", "x" * 300, "<s> don't"]
    rows = [pieces.library.encode(t) for t in texts] + [None, [], pieces.of_byte[[0xE6, 0x97]].tolist(), [1, 0, 2]]
    column = pa.array(rows, pa.list_(pa.int32()))
    for part in (column, column.slice(1), column.slice(3, 4), column.slice(0, 0)):
        for together in (1, 4, 10_000):
            assert suffix_pieces.decoded(part, pieces, together).to_pylist() == [
                suffix_pieces.decode(ids or [], pieces) for ids in part.to_pylist()]


def test_suffix_array_orders_suffixes():
    text = np.array([ord(c) for c in "banana" * 30] + [suffix_pieces._BORDER] * 16)
    got = suffix_pieces.suffix_array(text, 16)
    keys = [tuple(text[i:i + 16].tolist()) for i in got if i < 180]
    assert keys == sorted(keys)


def test_warc_matches_sql(spark):
    ok, message, _ = compare(queries.QUERIES["op8_warc"](spark, SF), connect(SF), queries.SQL["op8_warc"])
    assert ok, message


def test_warc_hard(spark):
    long = "<p>" + "x" * 200
    rows = [(5, "http://A.example/x", long), (2, "https://www.a.example/x", long), (9, None, long), (None, "http://[bad", long),
            (3, "http://a.example/x", "short"), (4, "http://a.example/x", "short"), (6, "", None), (7, "u\r\nv é", "é" * 60),
            (8, "http://a.example/x", "y" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    folder = work_folder(spark)
    warc.write_index(warc.write_archives(df, folder), folder)
    got = {r.page_id: r for r in warc.look_up(df, folder).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = html == long and page != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert bytes(r.payload or b"") == (b"" if revisit else raw)
    missing = spark.createDataFrame([(77, "http://a.example/x")], "page_id long, url string")
    assert warc.look_up(missing, folder).count() == 0


def test_url_keys_sort_by_reversed_host():
    assert warc.url_key("https://www.Example.com:443/A?b") == "com,example)/a?b"
    assert warc.url_key("http://m.x.org:8080") == "org,x,m:8080)/" and warc.url_key(None) == ")"


def brute_base(text):
    words = words_of(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), failed


def test_quality_rules(spark, hard, documents):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in queries.QUERIES["op9_quality_rules"](spark, SF).collect():
        assert tuple(r[n] for n in names) == brute_base(documents[r.doc_id])
        assert not (r.base_failed and r.kept)
    got = sorted(tuple(r[n] for n in names) for r in fertility.quality_rules(hard).collect())
    assert got == sorted(brute_base(r.text or "") for r in hard.collect())
    kept = [r.text for r in fertility.keep_sound(hard).collect()]
    assert len(kept) == fertility.quality_rules(hard).where("kept").count()


def test_fertility_measures_match_the_library():
    path = vocabulary_path("piece_bpe_32k.model")
    f = fertility.Fertility(path)
    for text in ("some plain words here some", "日本 ① ②", "Ünï ςΣ"):
        words = [w.encode() for w in text.split()]
        bag = collections.Counter(words)
        f.learn([bag])
        ids = [i for w in words for i in f._library.encode(w.decode())]
        share = np.array(list(collections.Counter(ids).values())) / len(ids)
        n, n_bytes, entropy = f.measure(bag)
        assert (n, n_bytes) == (len(ids), sum(map(f._library.is_byte, ids)))
        assert entropy == pytest.approx(-(share * np.log2(share)).sum())
    noise = "".join(chr(0x4E00 + 37 * i % 20000) for i in range(400))
    assert fertility.verdict(fertility.BANDS["en"], 400, 1200, 1100, 7.0) and fertility.script_of(noise) == "Han"


def test_lm_scores(spark, documents):
    tokens = {k: [*words_of(lower(t)), None] for k, t in documents.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in documents}
    c = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    got = mixing_lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), block_chars=40_000).collect()
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held-out: the mixture beats single counts
    whole = {r.doc_id: r.score for r in mixing_lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(whole[r.doc_id] == pytest.approx(r.score, rel=1e-4) for r in got)  # blocks do not show


def test_lm_probabilities_sum_to_one():
    """Over all words of a vocabulary, whatever the predictors say of each decision."""
    rng, classes, width = np.random.default_rng(0), 1 << mixing_lm.CLASS_BITS, 1 << mixing_lm.HASH_BITS
    hashes, known = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), rng.integers(1, 6, 500)
    leaf = (hashes >> np.uint64(64 - mixing_lm.HASH_BITS)).astype(int)
    leaves = np.zeros((classes, width), np.int64)
    np.add.at(leaves, (known, leaf), 1)
    code = mixing_lm.Code(leaves)
    node, bit, used = code.decisions(known, hashes)
    p, share = {}, np.ones(500)
    for i in range(500):
        for g in np.flatnonzero(used[i]):
            q = p.setdefault(int(node[i, g]), rng.random())
            share[i] *= q if bit[i, g] else 1 - q
    share /= 2 ** code.rest[known, leaf]
    classes_met = np.bincount(known, share)  # what is left of one belongs to classes and leaves without words
    assert 0 < share.sum() <= 1 + 1e-9 and (classes_met[1:] > 0).all()


def test_lm_hard(hard):
    got = mixing_lm.score_documents(hard).collect()
    assert len(got) == hard.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)


@pytest.mark.parametrize("run", [
    simhash.near_duplicates, token_counts.token_counts, packing.pack, fertility.quality_rules, fertility.keep_sound,
    suffix_pieces.encode_documents, mixing_lm.score_documents, simhash.keep_one,
    lambda d: ordinal.score(d, ordinal.Model({}, np.zeros(0)))])
def test_empty_tables(hard, run):
    assert run(hard.limit(0)).count() == 0


def test_empty_tables_of_pages_and_vectors(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0 and main_text.extract(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert threshold_topk.top_k(vectors, F.col("vec_id") % 50 == 0).count() == 0


def test_simhash_hard(hard):
    got = simhash.near_duplicates(hard).collect()
    assert len(got) == hard.count()
    zero = [r for r in got if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {0}


def test_pre_tokens_are_the_librarys():
    """Texts of every character below U+0300, by the narrow splitter and by the library."""
    from vellum.llm.pretokens import PreTokenizer

    tokens, rng = PreTokenizer(vocabulary_path("word_bpe_49k.json")), random.Random(4)
    for below in (0x80, 0x250, 0x300):
        for _ in range(300):
            text = "".join(chr(rng.randrange(below)) if rng.random() < 0.7 else rng.choice("'st 'll a1") for _ in range(60))
            want = tokens._library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(tokens.ids(tokens.split(text)), "<u4").tolist() == want, repr(text)

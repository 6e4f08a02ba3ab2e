"""Sources, sinks, streams, embedding and the end-to-end plans."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from vellum.functions import embedder
from vellum.operators import extraction as X, metrics, vectors
from vellum.plans import extract, ingest, summarize
from vellum.sources import readers, sinks
from vellum.streaming import logs


def test_text_files_and_types(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nhello", encoding="utf-8")
    (tmp_path / "b.py").write_text("x = 1", encoding="utf-8")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = {r.filename: r for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.py"} and got["a.md"].source_type == "notes" and got["b.py"].source_type == "code"
    assert got["a.md"].doc_id == hashlib.sha256(b"# T\n\nhello").hexdigest()


def test_question_answer_files(spark, tmp_path):
    pairs = [{"question": "q0", "answer": "a0"}, {"question": " ", "answer": "x"}, {"question": "q2", "answer": "a2"}]
    (tmp_path / "l.json").write_text(json.dumps(pairs))
    (tmp_path / "w.json").write_text(json.dumps({"items": pairs}, indent=1))
    rows = readers.question_answer_files(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {r.text for r in rows} == {"Q: q0\nA: a0", "Q: q2\nA: a2"}


def test_report_keeps_order(spark, tmp_path):
    rows = [(s, n, f"{s}-{n}") for s in range(5) for n in range(40)]
    sinks.write_report(spark.createDataFrame(rows[::-1], "section int, line_no bigint, line string"), str(tmp_path / "r"))
    text = [x for p in sorted((tmp_path / "r").glob("part-*")) for x in p.read_text().splitlines()]
    assert text == [r[2] for r in rows]


def test_checkpoint_names_pending_branches(spark, tmp_path):
    sinks.append_checkpoint(spark.createDataFrame([("a", 1)], "branch_name string, n int"), str(tmp_path / "c"))
    back = sinks.load_checkpoint(spark, str(tmp_path / "c"), "branch_name string, n int")
    assert sinks.pending_branches(["a", "b"], back) == ["b"]


def test_hash_embedding_matches_definition(spark):
    text, dim = "Alpha beta Alpha 9 gamma.", 32
    got = spark.createDataFrame([(text,)], "t string").select(embedder.hash_embedding(F.col("t"), dim).alias("v")).first().v
    want = np.zeros(dim)
    for tok in ["alpha", "beta", "alpha", "gamma."]:
        h = int.from_bytes(hashlib.blake2b(f"{embedder.SALT}:{tok}".encode(), digest_size=8).digest(), "big")
        want[h % dim] += -1.0 if (h >> 1) & 1 else 1.0
    assert np.allclose(got, want / np.linalg.norm(want))


def test_vector_top_k_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 6)).round(1)
    m[30:40] = m[3]
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "chunk_id bigint, embedding array<double>").repartition(7)
    qs = rng.normal(size=(5, 6))
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "query_id bigint, vector array<double>")
    got = {}
    for r in vectors.top_k(chunks, q, 12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    for i, v in enumerate(qs):
        s = (m @ v) / np.linalg.norm(m, axis=1) / np.linalg.norm(v)
        want = sorted(range(60), key=lambda j: (-round(s[j], 6), j))[:12]
        assert [c for _, c in sorted(got[i])] == want


def test_perfect_ranking_scores_one(spark):
    cases = spark.createDataFrame([("a", 3)], "case_id string, top_k bigint")
    ret = spark.createDataFrame([("a", i + 1, i) for i in range(3)], "case_id string, rank int, chunk_id int")
    rel = spark.createDataFrame([("a", i, 2 - i + 1) for i in range(3)], "case_id string, chunk_id int, gain int")
    m = metrics.per_case(cases, ret, rel).first()
    assert m.recall == m.precision == m.mrr == m.ndcg == m.graded_ndcg == m.average_precision == 1.0


def test_stream_numbers_and_cache(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(9)], "run_id bigint, event_id bigint, t string").select(
        "run_id", "event_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("run_id bigint, event_id bigint, ts timestamp").parquet(str(src))
    number = logs.number_batches(str(tmp_path / "o"))
    logs.ingest_batches(stream, number, str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_id, r.seq) for r in spark.read.parquet(str(tmp_path / "o/data")).collect()) == [(i, i + 1) for i in range(9)]
    seen = []
    writes = stream.withWatermark("ts", "1 hour").select(F.lit("k").alias("key"), F.col("event_id").cast("string").alias("value"), "ts")
    q = logs.cache_with_ttl(writes).writeStream.outputMode("update").foreachBatch(lambda b, i: seen.extend(b.collect())).option(
        "checkpointLocation", str(tmp_path / "k2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in seen] == ["8"]


def test_stream_numbers_of_a_long_run(spark, tmp_path):
    """More events than an Arrow batch holds, stored backwards, in two triggers; a replay changes nothing."""
    rows = spark.range(19_999, -1, -1, 1).select(F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("event_id"),
                                                 F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    number = logs.number_batches(str(tmp_path))
    number(rows.where("event_id < 12000"), 0)
    for _ in range(2):
        number(rows.where("event_id >= 12000"), 1)
    got = spark.read.parquet(f"{tmp_path}/data")
    assert got.count() == 20_000 and got.where("seq <> event_id + 1").count() == 0


def test_ingest_skips_unchanged(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "# One\n\nalpha beta gamma delta epsilon"), ("d2", "no heading here but words enough")], "doc_id string, text string")
    first = ingest.run(docs, None, str(tmp_path / "a"))
    assert {r.chunk_id for r in first.collect()} == {"d1-c000000", "d2-c000000"}
    stored = docs.select("doc_id", F.sha2("text", 256).alias("file_hash"))
    changed = docs.withColumn("text", F.when(F.col("doc_id") == "d2", "other words are in this text now").otherwise(F.col("text")))
    assert {r.doc_id for r in ingest.run(changed, stored, str(tmp_path / "b")).collect()} == {"d2"}


def test_extraction_project(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "f.pdf", i, f"the pump number {i} shall run at night and day in plant {i % 3} with care") for i in range(6)],
                                   "chunk_id int, source_name string, page_start int, text string")
    branches = (X.Branch("Pumps", ("pump",)), X.Branch("Night", ("night",), priorities=(("f.", 2.0),)), X.Branch("None", ("zzz",)))
    lines = extract.run(chunks, branches, F.lit(1.0), "P", str(tmp_path))
    text = [r.line for r in lines.orderBy("section", "line_no").collect()]
    assert text[0] == "# Extraction Report: P" and "_No items extracted for this branch._" in text
    items = spark.read.parquet(f"{tmp_path}/items").count()
    lost = spark.read.parquet(f"{tmp_path}/overrides").select("loser_chunk", "loser_branch").distinct().count()
    assert sum(x.startswith("- ") for x in text) == items - lost > 0


def test_pyramid_covers_every_part(spark):
    parts = spark.createDataFrame([("d", i, f"P{i:03d} is here. Rest {'x' * 80}.") for i in range(100)], "doc_id string, pos bigint, text string")
    keep_all = lambda ps: F.array_join(F.transform(ps, lambda p: F.regexp_replace(p, r"\. Rest x+\.", ".")), " ")
    out = summarize.pyramid(parts, keep_all, budget=2500).first().summary
    assert [w for w in out.split() if w.startswith("P")] == [f"P{i:03d}" for i in range(100)]

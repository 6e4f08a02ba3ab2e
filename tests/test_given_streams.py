"""Streams over given tables that are one file or a folder of files."""

import pyarrow.parquet as pq
import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("files", [1, 3])
def test_tables_in_files_and_folders(spark, tmp_path, files):
    docs = spark.createDataFrame([(i, f"common word{i % 3} {'x' * 5}") for i in range(12)], "doc_id long, text string")
    events = spark.createDataFrame([(i, 1_700_000_000 + i, i % 2) for i in range(12)], "event_id long, s long, user_id long").selectExpr(
        "event_id", "timestamp_seconds(s) AS ts", "user_id")
    for name, rows in (("documents", docs), ("events", events)):
        if files == 1:
            pq.write_table(rows.toArrow(), f"{tmp_path}/{name}.parquet")
        else:
            rows.repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.topic: r.df for r in queries()["streamed_topic_counts"](spark, str(tmp_path)).collect()}
    assert got == {"common": 12, "word0": 4, "word1": 4, "word2": 4, "xxxxx": 12} or got == {"common": 12, "word": 12, "xxxxx": 12}
    numbered = queries()["streamed_event_numbers"](spark, str(tmp_path)).collect()
    assert sorted((r.run_id, r.event_id, r.seq) for r in numbered) == sorted((i % 2, i, i // 2 + 1) for i in range(12))

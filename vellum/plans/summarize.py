"""Layered summaries: segments, then batches of summaries, until one fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import cleaning as C, text as T
from vellum.session import ensure_checkpoint_dir

REDUCE_CHARS = 24_000


def lead_sentences(parts: Column, each: int = 1) -> Column:
    """Offline reducer: the first sentence of every part."""
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.slice(C.sentences(p), 1, each), " ")), " ")


def pyramid(parts: DataFrame, reduce: Callable[[Column], Column] = lead_sentences, budget: int = REDUCE_CHARS) -> DataFrame:
    """(doc_id, summary) from ordered parts (doc_id, pos, text), pos counting from 0.

    A layer groups ``max(2, budget // average length)`` neighbouring parts and reduces
    each group, so no group exceeds about ``budget`` characters.  Documents that fit
    take one final reduction.  A layer at least halves a document's parts, so layers end after the logarithm
    of their number, whatever the reducer does.
    """
    ensure_checkpoint_dir(parts.sparkSession)
    cur, done = parts.select("doc_id", "pos", "text"), None
    while True:
        size = cur.groupBy("doc_id").agg(F.sum(F.length("text")).alias("_chars"), F.count("*").alias("_n"))
        j = cur.join(size, "doc_id")
        fits = (F.col("_chars") <= budget) | (F.col("_n") == 1)
        ready = j.where(fits).drop("_chars", "_n")
        done = ready if done is None else done.unionByName(ready)
        batch = F.greatest(F.lit(2), F.floor(budget / (F.col("_chars") / F.col("_n")))).cast("bigint")
        rest = j.where(~fits).withColumn("_g", F.floor(F.col("pos") / batch))
        cur = rest.groupBy("doc_id", F.col("_g").alias("pos")).agg(
            F.sort_array(F.collect_list(F.struct(rest["pos"], "text"))).alias("_p")).select(
            "doc_id", "pos", reduce(F.transform("_p", lambda s: s["text"])).alias("text")).checkpoint()
        if cur.isEmpty():
            break
    return done.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_p")).select(
        "doc_id", T.strip(reduce(F.transform("_p", lambda s: s["text"]))).alias("summary"))

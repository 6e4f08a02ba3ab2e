"""Retrieval quality, latency and pass-rate metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.operators import prefix

GENERAL_INTENTS = ("summary", "exploratory", "comparison", "list_lookup", "fact_lookup", "section_lookup")
DELTA_NOISE = 0.001
REGRESSION_STEP = 0.005


def _discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + F.lit(1))


def _ideal(n: Column) -> Column:
    """Ideal binary DCG of ``n`` relevant rows."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + _discount(i)))


def per_case(cases: DataFrame, retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Recall@k/1/3/5, precision (over what was returned), MRR, NDCG and AP per case.

    cases(case_id, top_k), retrieved(case_id, rank, chunk_id), relevant(case_id,
    chunk_id, gain).  Relevant rows meet retrieved rows by key; the per-case window
    runs over at most ``top_k`` rows.
    """
    r = retrieved.join(cases.select("case_id", "top_k"), "case_id").where(F.col("rank") <= F.col("top_k"))
    hit = r.join(relevant, ["case_id", "chunk_id"], "left").withColumn("hit", F.col("gain").isNotNull().cast("int"))
    upto = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hit.withColumn("seen", F.sum("hit").over(upto))

    def at(n: int) -> Column:
        return F.sum(F.when(F.col("rank") <= n, F.col("hit")).otherwise(0))

    got = h.groupBy("case_id").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), at(1).alias("h1"), at(3).alias("h3"), at(5).alias("h5"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("hit") == 1, _discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.coalesce("gain", F.lit(0)) * _discount(F.col("rank"))).alias("gdcg"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"))
    expected = relevant.groupBy("case_id").agg(F.count("*").alias("expected"))
    best = relevant.join(cases.select("case_id", "top_k"), "case_id").withColumn("_i", F.row_number().over(
        Window.partitionBy("case_id").orderBy(F.desc("gain"), "chunk_id"))).where(F.col("_i") <= F.col("top_k"))
    ideal = best.groupBy("case_id").agg(F.sum(F.col("gain") * _discount(F.col("_i"))).alias("gideal"))
    m = (cases.join(expected, "case_id").join(got, "case_id", "left").join(ideal, "case_id", "left")
         .fillna(0, ["n", "hits", "h1", "h3", "h5"]).fillna(0.0, ["dcg", "gdcg", "ap"]))
    e = F.col("expected")
    return m.select(
        *cases.columns, "expected", (F.col("hits") / e).alias("recall"), (F.col("h1") / e).alias("recall_1"),
        (F.col("h3") / e).alias("recall_3"), (F.col("h5") / e).alias("recall_5"),
        F.coalesce(F.try_divide(F.col("hits"), F.col("n")), F.lit(0.0)).alias("precision"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(F.col("dcg"), _ideal(F.least(e, F.col("top_k")))), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.try_divide(F.col("gdcg"), F.col("gideal")), F.lit(0.0)).alias("graded_ndcg"),
        (F.col("ap") / e).alias("average_precision"))


METRICS = ("recall", "precision", "mrr", "ndcg", "average_precision")


def aggregate(case_metrics: DataFrame, *keys: str) -> DataFrame:
    return case_metrics.groupBy(*keys).agg(
        F.count("*").alias("cases"), *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in METRICS])


def deltas(current: DataFrame, previous: DataFrame, key: str, value: str, step: float = REGRESSION_STEP) -> DataFrame:
    """Change per key against an earlier snapshot; only keys in both count."""
    p = previous.select(key, F.col(value).alias("_old"))
    d = F.round(F.col(value) - F.col("_old"), 6)
    return current.join(p, key).select(key, F.col("_old").alias("old_value"), F.col(value).alias("new_value"), d.alias("delta"),
                                       F.when(d < -step, "regression").when(d > step, "improved").otherwise("same").alias("verdict"))


def compare_to_baseline(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Category pass rates; a category compares only when both runs counted the same cases."""
    b = baseline.select("category", F.col("passed").alias("bp"), F.col("n").alias("bn"))
    c = current.select("category", F.col("passed").alias("cp"), F.col("n").alias("cn"))
    j = b.join(c, "category", "full")
    same = F.col("bn") == F.col("cn")
    d = F.col("cp") / F.col("cn") - F.col("bp") / F.col("bn")
    status = (F.when(F.col("bn").isNull(), "new").when(F.col("cn").isNull(), "gone").when(~same, "not_comparable")
              .when(F.abs(d) < DELTA_NOISE, "unchanged").when(d > 0, "improvement").otherwise("regression"))
    return j.select("category", status.alias("status"), F.when(same, F.round(d, 6)).alias("delta"))


def _order_statistic(numbered: DataFrame, keys: Sequence[str], position: Column, name: str) -> DataFrame:
    """Value at a fractional 1-based position, interpolated between its two neighbours."""
    low = F.floor(position)
    w = position - low
    v = F.col("value")
    return numbered.groupBy(*keys).agg(
        (F.max(F.when(F.col("_rn") == low, v)) * (1 - F.max(w))
         + F.coalesce(F.max(F.when(F.col("_rn") == low + 1, v)), F.lit(0.0)) * F.max(w)).alias(name))


def latency_quantiles(samples: DataFrame, keys: Sequence[str], tie: str, bucket_width: float = 1.0) -> DataFrame:
    """p50 (median) and p95 (exclusive method; the maximum below 20 samples) of ``value``.

    Rows are numbered bucket by bucket, so a key with very many samples is never
    sorted in one task.
    """
    n = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.max("value").alias("_max"))
    rn = prefix.row_numbers(samples, list(keys), [F.col("value"), F.col(tie)], F.floor(F.col("value") / bucket_width), "_rn")
    j = rn.join(n, list(keys))
    p50 = _order_statistic(j, keys, (F.col("n") + 1) / 2, "p50")
    p95 = _order_statistic(j, keys, F.col("n").cast("double") * 0 + F.least(F.greatest(
        (F.col("n") + 1) * 19 / 20, F.lit(1.0)), F.col("n").cast("double")), "_p95")
    return n.join(p50, list(keys)).join(p95, list(keys)).select(
        *keys, "n", F.round("p50", 6).alias("p50"),
        F.round(F.when(F.col("n") >= 20, F.col("_p95")).otherwise(F.col("_max")), 6).alias("p95"))


def parameter_grid(axes: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """Every combination of the axes (configuration-sized, built on the driver)."""
    return [dict(zip(axes, combo)) for combo in product(*axes.values())]


def pass_rates(results: DataFrame, config: str, axis: str, axes: Sequence[str]) -> DataFrame:
    """Pass rate per configuration, overall and per stress axis."""
    p = F.col("passed").cast("int")

    def rate(cond: Column | None) -> Column:
        num = F.sum(p if cond is None else F.when(cond, p).otherwise(0))
        den = F.count("*") if cond is None else F.count(F.when(cond, 1))
        return F.round(F.coalesce(F.try_divide(num, den), F.lit(0.0)), 3)

    return results.groupBy(config).agg(
        F.count("*").alias("n_total"), F.sum(p).alias("n_pass"), rate(None).alias("pass_rate"),
        *[rate(F.col(axis) == a).alias(f"rate_{a}") for a in axes])


def threshold_sweep(scored: DataFrame, score: str, truth: Column, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, accepted, correct): decisions ``score > t`` for every t, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(score) > t).alias("yes")) for t in thresholds])
    return scored.select(truth.alias("truth"), F.explode(pairs).alias("d")).groupBy("d.threshold").agg(
        F.count(F.when(F.col("d.yes"), 1)).alias("accepted"), F.count(F.when(F.col("d.yes") == F.col("truth"), 1)).alias("correct"))


def intent_matches(actual: Column, expected: Column) -> Column:
    """Exact, or both within the interchangeable general intents; no expectation always matches."""
    general = F.array(*[F.lit(i) for i in GENERAL_INTENTS])
    return ((F.size(expected) == 0) | F.array_contains(expected, actual)
            | (actual.isin(*GENERAL_INTENTS) & F.arrays_overlap(expected, general)))


def failed_checks(checks: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def merge_cases(stored: DataFrame, seeded: DataFrame) -> DataFrame:
    """Seeded cases join stored ones: known ids keep their stored row, new ids are appended."""
    return stored.unionByName(seeded.join(stored.select("case_id"), "case_id", "left_anti"))


def source_diversity(hits: DataFrame, top: int, need: int) -> DataFrame:
    lead = hits.where(F.col("rank") <= top)
    return lead.groupBy("query_id").agg(F.countDistinct("doc_id").alias("sources")).withColumn(
        "diverse", F.col("sources") >= need)

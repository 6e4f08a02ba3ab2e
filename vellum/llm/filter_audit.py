"""Interaction of filters: what every filter removes, finds already gone or alone would catch, in every order.

One table of failing ids is stored for each filter.  Every set of filters is the prefix of some
order, so a left-anti join of the documents, once for every set, with the failing ids of the set's
filters gives the survivors of every prefix; a left-anti join of a filter's own failing ids, once for
every set without it, gives what it removes after that prefix, and the left-semi join of the same rows
what it fails that was gone already.  Orders then only look those counts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import as_table, drop_table, work_folder

#: Failure conditions over the columns of :func:`facts`; E is found table-wide by :func:`repeated`.
CONDITIONS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "n_symbols > 0",
}
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_FACTS = ("doc_id long, part string, n_words long, n_distinct long, n_upper long, n_chars long, n_symbols long, "
          "digest binary")
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def measure(text: str) -> tuple[int, int, int, int, int, bytes]:
    """Words, distinct words, A-Z, code points, symbols and SHA-256 of one whole text."""
    raw = text.encode()
    words = raw.split()  # bytes: only ASCII white space parts
    return (len(words), len(set(words)), len(raw) - len(raw.translate(None, UPPER)), len(text),
            len(raw) - len(raw.translate(None, SYMBOLS)), hashlib.sha256(raw).digest())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(zip(*map(measure, batch.column(2).to_pylist()))) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in found[:5]),
             pa.array(found[5], pa.binary())], schema=_ARROW)


_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()),
                    *((c, pa.int64()) for c in ("n_words", "n_distinct", "n_upper", "n_chars", "n_symbols")),
                    ("digest", pa.binary())])


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What the conditions ask of every text (null text or part: empty), in one scan."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_measured, _FACTS)


def repeated(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, ...) whose text some smaller doc_id has too.

    Those are the rows that are not their text's first: one aggregate and a join on the pair of text
    and id, so that a text of a third of all rows is spread over all tasks.
    """
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return named.join(first, ["digest", "doc_id"], "left_anti")


def outcomes(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) once for every labelled id: whether any of its labels says so."""
    return (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.coalesce(F.max(F.expr("int(quality = 1)")), F.lit(0)).alias("good"),
                 F.coalesce(F.max(F.expr("int(toxic = 1)")), F.lit(0)).alias("toxic")))


def interactions(members: DataFrame, fails: dict[str, DataFrame], folder: str) -> DataFrame:
    """Counts for every part, order of the filters and step.

    ``members`` holds every document once (id, part, good, toxic: 0 or 1), ``fails`` for every filter the
    table of failing ids, each id once.  A set of filters is a number with one bit a filter.  Documents
    and ids are dealt by id once; the copies for the sets are made after that, inside the tasks.  What is
    removed, at most one row for each part, filter and set, is kept below ``folder``.
    """
    names = sorted(fails)
    everything = (1 << len(names)) - 1
    failing = None
    for i, name in enumerate(names):
        one = fails[name].select("id", F.lit(1 << i).alias("bit"))
        failing = one if failing is None else failing.union(one)
    dealt = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not merged: each row becomes many
    spread, failing = members.repartition(dealt, "id"), failing.repartition(dealt, "id")
    gone = failing.select(F.col("id").alias("gone"), F.col("bit").alias("by"))
    caught = (F.col("id") == F.col("gone")) & (F.col("prefix").bitwiseAND(F.col("by")) != 0)
    sets = F.array(*(F.lit(s) for s in range(everything + 1)))

    kept = (spread.select("id", "part", F.explode(sets).alias("prefix"))
            .join(gone, caught, "left_anti").groupBy("part", "prefix").agg(F.count("*").alias("kept")))
    own = (spread.join(failing, "id")
           .select("id", "part", "good", "toxic", "bit",
                   F.explode(F.filter(sets, lambda s: s.bitwiseAND(F.col("bit")) == 0)).alias("prefix")))
    removed = as_table(own.join(gone, caught, "left_anti").groupBy("part", "bit", "prefix").agg(
        F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")),
        f"{folder}/removed")
    redundant = own.join(gone, caught, "left_semi").groupBy("part", "bit", "prefix").agg(
        F.count("*").alias("redundant"))

    n = len(names)
    orders_of = F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)))
    shares = removed.groupBy("part", "bit").agg(
        F.sum(F.col("removed") * F.get(orders_of, F.bit_count("prefix"))).cast("long").alias("shapley"),
        F.sum(F.when(F.col("prefix") + F.col("bit") == everything, F.col("removed"))).alias("unique_fails"))
    steps = []
    for order in permutations(range(n)):
        name = "".join(names[i] for i in order)
        for k, i in enumerate(order):
            before = sum(1 << j for j in order[:k])
            steps.append(f"struct('{name}', {k + 1}, {1 << i}, {before}, {before | 1 << i})")
    listed = members.select("part").distinct().selectExpr(
        "part", f"inline(array({', '.join(steps)})) AS (filter_order, step, bit, prefix, after)")
    return (listed.join(kept.withColumnRenamed("prefix", "after"), ["part", "after"], "left")
            .join(removed, ["part", "bit", "prefix"], "left").join(redundant, ["part", "bit", "prefix"], "left")
            .join(shares, ["part", "bit"], "left")
            .select("part", "filter_order", "step", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in _MEASURES)))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """Every part's counts for the five filters in all 120 orders.

    Every row of ``docs`` counts as one document: repeated rows have the same fate, but for an equal text
    under an equal id, which fails E in neither.  A row without id never fails E and has no labels; null
    texts and parts are empty, an empty text fails A alone.  A label other than 1, null included, is none,
    and one of several labels is enough.  Other columns are ignored; no documents give no rows.
    """
    folder = work_folder(docs.sparkSession)
    rows = as_table(facts(docs, id_col, text_col, part_col).withColumn("id", F.monotonically_increasing_id()),
                    f"{folder}/facts")
    members = as_table(rows.select("id", "doc_id", "part").join(outcomes(labels), "doc_id", "left")
                       .select("id", "part", F.coalesce("good", F.lit(0)).alias("good"),
                               F.coalesce("toxic", F.lit(0)).alias("toxic")), f"{folder}/members")
    found = {name: rows.where(condition) for name, condition in CONDITIONS.items()} | {"E": repeated(rows)}
    fails = {name: as_table(df.select("id"), f"{folder}/fails_{name}") for name, df in found.items()}
    drop_table(docs.sparkSession, f"{folder}/facts")
    return interactions(members, fails, folder)

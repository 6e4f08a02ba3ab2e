"""Divergence of sources within their language, over vocabularies held as minimal transducers.

A first scan finds each language's terms and how many documents hold them; the terms of enough
documents are sorted, and every run of ``SHARD`` of them becomes one minimal acyclic transducer
(:mod:`vellum.llm.transducer`), built in the task that sorted the run.  A second scan streams the texts
through their language's transducers and counts ordinals by source.  Shares of terms, differences
and ranks are exact integers, and equal differences rank by ordinal, which is the order of the terms.

Transducers reach the tasks by broadcasts of at most ``SENT`` bytes; if all together are larger, there
is one scan of the texts for each part of them, so that no task holds a whole vocabulary of any size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import as_table, work_folder
from vellum.llm.transducer import Transducer

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1000, 50
#: Terms of one transducer; bytes of transducers sent at once; terms counted before a task lets go of its counts.
SHARD, SENT, HELD = 1 << 18, 32 << 20, 1 << 19
#: Bytes of text put together, cursors that run together; cells of one matrix of counts.
WINDOW, CURSORS, CELLS = 1 << 23, 1 << 18, 1 << 20
_LETTER = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_LOWER = bytes((b | 32 if b < 128 else b) if _LETTER[b] else 32 for b in range(256))
_ENDED = _LOWER.replace(b" ", b"\0")


def _columns(docs: DataFrame, *cols: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in zip(cols, ("lang", "source", "text"))))


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, term, docs): partial numbers of documents."""
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(map(bytes.decode, own), pa.string()),
                                              pa.array(own.values(), pa.int64())], names=["lang", "term", "docs"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            counts.setdefault(lang, Counter()).update(set(text.encode().translate(_LOWER).split()))
        if sum(map(len, counts.values())) > HELD:
            yield from out()
    yield from out()


def kept_terms(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term): what at least ``least_docs`` documents (lang, source, text) of the language hold."""
    return (rows.mapInArrow(_spellings, "lang string, term string, docs long").groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"))


def _built(size: int):
    """Sorted (lang, term) to (lang, low, terms, body): a transducer for every run of ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([held[0].decode()]), pa.array([len(held)]),
                                                  pa.array([Transducer.build(held).dump()])], names=["lang", "low", "terms", "body"])
            held.clear()

        for batch in batches:
            for own, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != lang or len(held) == size:
                    yield from out()
                lang = own
                held.append(term.encode())
        yield from out()

    return run


def transducers(kept: DataFrame, size: int = SHARD) -> DataFrame:
    """(lang, low, terms, body, base): a language's transducers in the order of their least term ``low``; the
    ordinals of one begin at ``base``."""
    shards = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        _built(size), "lang string, low string, terms long, body binary")
    before = Window.partitionBy("lang").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("terms").over(before), F.lit(0)))


def _loaded(sent: Broadcast) -> dict[str, list[tuple[int, int, Transducer]]]:
    """Transducers by language, each with its ordinals' beginning and end (arrays are views of what was sent)."""
    by_lang: dict[str, list[tuple[int, int, Transducer]]] = {}
    for lang, base, terms, body in sent.value:
        by_lang.setdefault(lang, []).append((base, base + terms, Transducer.load(body)))
    return by_lang


def _starts(data: np.ndarray) -> np.ndarray:
    inside = data != 0
    inside[1:] &= data[:-1] == 0
    return np.flatnonzero(inside)


def _found(own: list[tuple[int, int, Transducer]], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ordinals within the language of the terms that begin at ``at``, -1 for what is in none of ``own``."""
    best = np.full(len(at), -1, np.int64)
    for base, _, machine in own:
        for i in range(0, len(at), CURSORS):
            found = machine.ordinals(data, at[i: i + CURSORS])
            best[i: i + CURSORS] = np.where(found >= 0, found + base, best[i: i + CURSORS])
    return best


class _Recount:
    """Occurrences by source and ordinal of one language in one task."""

    def __init__(self, own: list[tuple[int, int, Transducer]]) -> None:
        self.own, self.width = own, max(end for _, end, _ in own)
        self.sources: dict[str, int] = {}
        self.keys, self.counts = [], []

    def add(self, texts: list[bytes], sources: list[str]) -> int:
        codes = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        data = np.frombuffer(b" ".join(texts).translate(_ENDED) + b"\0", np.uint8)
        at, ends = _starts(data), np.cumsum([len(t) + 1 for t in texts])
        found = _found(self.own, data, at)
        at, found = at[found >= 0], found[found >= 0]
        keys, counts = np.unique(codes[np.searchsorted(ends, at, "right")] * self.width + found, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        if len(self.keys) == 16:
            self.sum_up()
        return sum(map(len, self.keys))

    def sum_up(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts = [keys], [np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)]

    def rows(self, lang: str) -> pa.RecordBatch:
        self.sum_up()
        source, ordinal = np.divmod(self.keys[0], self.width)
        names = pa.DictionaryArray.from_arrays(pa.array(source), pa.array(self.sources, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(source), pa.string()), names, pa.array(ordinal),
                                           pa.array(self.counts[0])], names=["lang", "source", "ordinal", "n"])


def _recounted(sent: Broadcast):
    """(lang, source, text) to (lang, source, ordinal, n): partial counts of the sent transducers' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, counts, held = _loaded(sent), {}, {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                yield own.rows(lang)
            counts.clear()
            held.clear()

        def count(lang: str, texts: list[bytes], sources: list[str]) -> None:
            held[lang] = counts.setdefault(lang, _Recount(machines[lang])).add(texts, sources)

        for batch in batches:
            waiting: dict[str, tuple[list[bytes], list[str]]] = {}
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in machines:
                    texts, sources = waiting.setdefault(lang, ([], []))
                    texts.append(text.encode())
                    sources.append(source)
                    if len(texts) % 64 == 0 and sum(map(len, texts)) > WINDOW:
                        count(lang, *waiting.pop(lang))
            for lang, own in waiting.items():
                count(lang, *own)
            if sum(held.values()) > HELD:
                yield from out()
        yield from out()

    return run


def _placed(sent: Broadcast):
    """(lang, term) to (lang, ordinal, term) for the terms of the sent transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _loaded(sent)
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, term in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append(term)
            for lang in by_lang.keys() & machines.keys():
                data = np.frombuffer(b"\0".join(t.encode() for t in by_lang[lang]) + b"\0", np.uint8)
                found = _found(machines[lang], data, _starts(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(by_lang[lang], pa.string())],
                    names=["lang", "ordinal", "term"]).filter(pa.array(found >= 0))

    return run


def parts(machines: DataFrame, sent_bytes: int = SENT) -> Iterator[Broadcast]:
    """Broadcasts that together hold every transducer once, each of at most ``sent_bytes`` or of one transducer."""
    machines = machines.withColumn("bytes", F.length("body"))
    listed = machines.select("lang", "low", "bytes").orderBy("lang", "low").collect()  # one row for SHARD terms
    at = 0
    while at < len(listed):
        end, total = at + 1, listed[at].bytes
        while end < len(listed) and total + listed[end].bytes <= sent_bytes:
            total, end = total + listed[end].bytes, end + 1
        first, last = (F.struct(F.lit(r.lang).alias("lang"), F.lit(r.low).alias("low")) for r in (listed[at], listed[end - 1]))
        rows = machines.where(F.struct("lang", "low").between(first, last)).select("lang", "base", "terms", "body").collect()
        yield machines.sparkSession.sparkContext.broadcast([(r.lang, r.base, r.terms, bytes(r.body)) for r in rows])
        at = end


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact: long division by three digits of base 1000
    keeps every step within 64 bits up to a total of 9 * 10^15."""
    whole, rest = np.zeros_like(counts), counts + SMOOTH
    below = total + SMOOTH * terms
    for _ in range(3):
        rest = rest * SCALE
        whole, rest = whole * SCALE + rest // below, rest % below
    return 1 + whole


def _compared(top: int):
    """One slice of a language's ordinals: counts by source, and every source with its total.

    Gives every pair's sum of differences over the slice, and of each source the ``top`` terms that exceed
    the language's share by most.
    """

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        slice_at, width, terms = key[1].as_py(), groups["width"][0].as_py(), groups["terms"][0].as_py()
        names = sorted(groups["source"].to_pylist())
        row_of = {s: i for i, s in enumerate(names)}
        total = np.zeros((len(names), 1), np.int64)
        total[[row_of[s] for s in groups["source"].to_pylist()], 0] = groups["total"].to_numpy()
        low = slice_at * width
        held = np.zeros((len(names), min(width, terms - low)), np.int64)
        if counts.num_rows:
            held[[row_of[s] for s in counts["source"].to_pylist()], counts["ordinal"].to_numpy() - low] = counts["n"].to_numpy()
        pairs, best = [], []
        if terms:
            own, whole = shares(held, total, terms), shares(held.sum(0), np.array(groups["lang_total"][0].as_py()), terms)
            for i, name in enumerate(names):
                pairs.append(np.abs(own[i + 1:] - own[i]).sum(1))
                over = np.flatnonzero((held[i] > 0) & (own[i] > whole))
                value = own[i, over] - whole[over]
                order = np.argsort(-value, kind="stable")[:top]
                best += [(name, low + o, v) for o, v in zip(over[order].tolist(), value[order].tolist())]
        else:
            pairs = [np.zeros(len(names) - 1 - i, np.int64) for i in range(len(names))]
        out = [(name, other, None, v) for i, name in enumerate(names) for other, v in zip(names[i + 1:], pairs[i].tolist())]
        out += [(name, None, o, v) for name, o, v in best]
        source, other, ordinal, value = zip(*out) if out else ((),) * 4
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()), "source": pa.array(source, pa.string()),
                         "other": pa.array(other, pa.string()), "ordinal": pa.array(ordinal, pa.int64()),
                         "value": pa.array(value, pa.int64())})

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text", shard: int = SHARD, sent_bytes: int = SENT, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair`` holds each other source of the language and the sum of the differences of all kept terms'
    shares (0 if none is kept), part ``term`` the ``top`` kept terms of the source whose share exceeds the
    language's most.  Nulls are empty strings, which are a language or source like any other; repeated rows
    are documents of their own; texts of any length count whole; equal values rank by the bytes of the item.
    Other columns are ignored, and no documents give no rows.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    rows = _columns(docs, lang_col, source_col, text_col)
    kept = as_table(kept_terms(rows, least_docs), f"{folder}/kept")
    machines = as_table(transducers(kept, shard), f"{folder}/machines")
    partial = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    placed = spark.createDataFrame([], "lang string, ordinal long, term string")
    for sent in parts(machines, sent_bytes):
        partial = partial.union(rows.mapInArrow(_recounted(sent), partial.schema))
        placed = placed.union(kept.mapInArrow(_placed(sent), placed.schema))
    counts = as_table(partial.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), f"{folder}/counts")

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = machines.groupBy("lang").agg(F.sum("terms").alias("terms"))
    groups = (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.greatest(
        F.floor(F.lit(cells) / F.count("*")), F.lit(1)).alias("width"))
    groups = as_table(groups.join(whole, "lang"), f"{folder}/groups")
    widths = groups.select("lang", "width").distinct().toDF("lang", "wide")
    sliced = counts.join(widths, "lang").select("lang", "source", "ordinal", "n", F.expr("ordinal div wide").alias("slice"))
    wanted = groups.withColumn("slice", F.explode(F.expr("sequence(0L, greatest((terms - 1) div width, 0L))")))
    compared = as_table(sliced.groupBy("lang", "slice").cogroup(wanted.groupBy("lang", "slice")).applyInArrow(
        _compared(top), "lang string, source string, other string, ordinal long, value long"), f"{folder}/compared")

    pairs = compared.where("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.inline(F.array(F.struct("source", F.col("other").alias("item"), "value"), F.struct(
        F.col("other").alias("source"), F.col("source").alias("item"), "value"))))
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    ranked = compared.where("ordinal IS NOT NULL").withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top)
    terms = ranked.join(placed, ["lang", "ordinal"])
    return (pairs.withColumn("rank", F.row_number().over(by_item))
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
            .union(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")))

"""Sections to chunks, and merging of undersized neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import text as T, vocab
from vellum.operators import folds

P = vocab.CHUNKING
SENTENCE_BREAK = r"(?<=[.!?])[ \t]+"


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), T.strip), lambda s: F.length(s) > 0)


def _unit(text: Column, scope: Column, solid: Column, sep: str, size: Column | None = None) -> Column:
    size = T.estimate_tokens(text) if size is None else size
    return F.struct(text.alias("text"), size.alias("size"), scope.alias("scope"),
                    solid.alias("solid"), F.lit(sep).alias("sep"))


def _cap(chunks: Column, width: int) -> Column:
    return F.flatten(F.transform(chunks, lambda c: folds.char_windows(c, width)))


def paragraph_segments(text: Column, max_tokens: int = P["max_tokens"], max_chars: int = P["max_chars"]) -> Column:
    """Whole paragraphs packed to a token budget; long paragraphs by sentence, long sentences by words.

    Small paragraphs share scope -1; every oversized paragraph is a scope of its own,
    so its sentences never join its neighbours.
    """
    words = max(20, int(max_tokens / 1.3))

    def sentence_units(para: Column, i: Column) -> Column:
        def units(s: Column) -> Column:
            return T.let(T.estimate_tokens(s), lambda n: F.when(
                n > max_tokens, F.transform(folds.word_windows(s, words), lambda w: _unit(w, i, F.lit(True), " "))
            ).otherwise(F.array(_unit(s, i, F.lit(False), " ", n))))
        return F.flatten(F.transform(_pieces(para, SENTENCE_BREAK), units))

    def para_units(para: Column, i: Column) -> Column:
        return T.let(T.estimate_tokens(para), lambda n: F.when(n > max_tokens, sentence_units(para, i)).otherwise(
            F.array(_unit(para, F.lit(-1), F.lit(False), "\n\n", n))))

    units = F.flatten(F.transform(_pieces(text, r"\n{2,}"), para_units))
    return _cap(folds.pack_units(units, max_tokens), max_chars)


def table_segments(text: Column, max_tokens: int = 2 * P["max_tokens"], max_chars: int = P["max_chars"]) -> Column:
    """Tables split at blank lines only, so rows stay whole; a hard character cap still holds."""
    paras = F.transform(_pieces(text, r"\n{2,}"), lambda p: _unit(p, F.lit(-1), F.lit(False), "\n\n"))
    fits = (T.estimate_tokens(text) <= max_tokens) & (F.length(text) <= max_chars)
    return F.when(fits, F.array(text)).otherwise(_cap(folds.pack_units(paras, max_tokens), max_chars))


def chunk_sections(secs: DataFrame, max_tokens: int = P["max_tokens"]) -> DataFrame:
    """Chunks of enriched sections; ids count kept chunks per document in section order."""
    s = secs.where(T.strip(F.col("content")) != "").withColumn("content", T.strip(F.col("content")))
    role = F.when((F.col("structural_role") == "body") & (
        T.text_or_empty(F.col("title")).rlike(vocab.BIBLIOGRAPHY_TITLE)
        | T.text_or_empty(F.col("path_text")).rlike(vocab.BIBLIOGRAPHY_TITLE)), "bibliography").otherwise(
        F.col("structural_role"))
    segs = F.when(F.col("has_table"), table_segments(F.col("content"), 2 * max_tokens)).otherwise(
        paragraph_segments(F.col("content"), max_tokens))
    rows = s.withColumn("structural_role", role).select(
        "doc_id", "section_idx", "section_id", "title", "path_text", "level", "page_start", "page_end", "has_table",
        "structural_role", F.posexplode(segs).alias("part", "segment")).where(~T.low_value(F.col("segment")))
    head = F.when(T.text_or_empty(F.col("title")) != "", F.concat("title", F.lit("\n\n"))).otherwise("")
    body = F.concat(head, F.when(F.col("has_table"), "[ TABLE ]\n").otherwise(""), F.col("segment"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_idx", "part")) - 1
    return rows.withColumns({"text": body, "idx": idx}).select(
        F.format_string("%s-c%06d", F.col("doc_id").cast("string"), "idx").alias("chunk_id"), "doc_id", "section_id", "title",
        "path_text", "level", "page_start", "page_end", "has_table", "structural_role", "idx",
        T.estimate_tokens(F.col("text")).alias("token_count_est"), T.word_count(F.col("text")).alias("word_count"), "text")


def merge_small(chunks: DataFrame, min_tokens: int = P["min_tokens"], most: int = P["merge_max_tokens"]) -> DataFrame:
    """Fold undersized chunks into the previous one, then forward into the next, within a section.

    Runs over one document's ordered chunk list.  A backward merge keeps the earlier
    chunk and takes the later page_end; a forward merge keeps the later chunk but for
    id and page_start.
    """
    cols = [c for c in chunks.columns if c not in ("doc_id", "idx")]
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", *cols))).alias("_all"))

    def rebuilt(base: Column, new: dict[str, Column]) -> Column:
        return F.struct(*[new.get(c, base[c]).alias(c) for c in ["idx", *cols]])

    def joined(a: Column, b: Column) -> dict[str, Column]:
        return {"text": T.strip(F.concat(T.rstrip(a["text"]), F.lit("\n\n"), T.lstrip(b["text"]))),
                "token_count_est": a["token_count_est"] + b["token_count_est"],
                "word_count": a["word_count"] + b["word_count"]}

    def fits(a: Column, b: Column) -> Column:
        return (a["section_id"] == b["section_id"]) & (a["token_count_est"] + b["token_count_est"] <= most)

    def fold(arr: Column, absorbs, merged) -> Column:
        first, rest = F.element_at(arr, 1), F.slice(arr, 2, F.size(arr))
        start = F.struct(F.slice(arr, 1, 0).alias("done"), first.alias("cur"))

        def step(acc: Column, x: Column) -> Column:
            cur = acc["cur"]
            return F.when(absorbs(cur, x) & fits(cur, x), F.struct(acc["done"].alias("done"), merged(cur, x).alias("cur"))
                          ).otherwise(F.struct(F.concat(acc["done"], F.array(cur)).alias("done"), x.alias("cur")))

        return F.aggregate(rest, start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))

    back = fold(F.col("_all"), lambda cur, x: x["token_count_est"] < min_tokens,
                lambda cur, x: rebuilt(cur, {**joined(cur, x), "page_end": x["page_end"]}))
    passed = listed.select("doc_id", back.alias("_all"))
    ahead = fold(F.col("_all"), lambda cur, x: cur["token_count_est"] < min_tokens,
                 lambda cur, x: rebuilt(x, {**joined(cur, x), "chunk_id": cur["chunk_id"], "idx": cur["idx"],
                                            "page_start": cur["page_start"]}))
    return passed.select("doc_id", F.explode(ahead).alias("c")).select("doc_id", "c.*")


def chunk_plain_text(sources: DataFrame, max_tokens: int = P["max_tokens"]) -> DataFrame:
    """Plain text sources: paragraph packing only, no low-value filter, ids by position."""
    rows = sources.select("doc_id", "title", F.posexplode(paragraph_segments(F.col("text"), max_tokens)).alias("idx", "text"))
    return rows.select(F.format_string("%s-c%06d", F.col("doc_id").cast("string"), "idx").alias("chunk_id"), "doc_id", "title", "idx",
                       T.estimate_tokens(F.col("text")).alias("token_count_est"), "text")


CHUNK_ID = r"^(.+)-c(\d{6})$"


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(chunk_id, neighbour_id, offset): adjacent chunks by decoded index; gaps stay gaps."""
    offsets = [o for o in range(-window, window + 1) if o]
    h = hits.select("chunk_id", F.regexp_extract("chunk_id", CHUNK_ID, 1).alias("_d"),
                    F.regexp_extract("chunk_id", CHUNK_ID, 2).alias("_i")).where("_i <> ''").withColumn(
        "offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    want = h.withColumn("_n", F.col("_i").cast("int") + F.col("offset")).where("_n >= 0").select(
        "chunk_id", "offset", F.format_string("%s-c%06d", "_d", "_n").alias("neighbour_id"))
    return want.join(chunks.select(F.col("chunk_id").alias("neighbour_id")), "neighbour_id", "left_semi")


def apply_page_replacements(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Replace chunk text by the artifact texts of its pages, in page order, each text once.

    Pages are exploded to an equi-join on (doc, page) instead of a range join; only
    image and form artifacts with replacement text take part.
    """
    use = artifacts.where(F.col("artifact_kind").isin("image", "form")
                          & (F.length(T.strip(F.col("replacement_text"))) > 0)).select(
        "doc_id", F.col("page_number").alias("_page"), "artifact_index", T.strip(F.col("replacement_text")).alias("_t"))
    pages = chunks.where("page_start IS NOT NULL").select(
        "chunk_id", "doc_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("_page"))
    texts = pages.join(use, ["doc_id", "_page"]).groupBy("chunk_id").agg(F.array_join(F.array_distinct(F.transform(
        F.sort_array(F.collect_list(F.struct("_page", "artifact_index", "_t"))), lambda s: s["_t"])), "\n\n").alias("_new"))
    return chunks.join(texts, "chunk_id", "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")

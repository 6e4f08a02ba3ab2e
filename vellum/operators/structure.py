"""Markdown to sections: lines are exploded, windows carry pages and headings forward.

A document is one input row, so every window and list below is bounded by the
size of a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import cleaning as C, text as T, vocab

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
PAGE_MARKER = r"^<!--\s*page:(\d+)\s*-->\s*$"
NO_PAGE = 9999


def _body_start(ls: Column) -> Column:
    """Lines before this index are frontmatter; an unterminated block is not frontmatter."""
    opened = T.strip(F.element_at(ls, 1)) == "---"
    rest = F.transform(F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), T.strip)
    end = F.array_position(rest, F.lit("---"))
    return F.when(opened & (end > 0), end + 1).otherwise(F.lit(0)).cast("int")


def frontmatter(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value) of ``key: value`` lines in a terminated frontmatter block; last key wins."""
    block = T.let(F.split(C.unix_newlines(F.col("text")), "\n", -1), lambda ls: F.slice(ls, 1, _body_start(ls)))
    head = docs.select("doc_id", F.posexplode(block).alias("pos", "line"))
    kv = head.where(F.contains("line", F.lit(":")) & (T.strip(F.col("line")) != "---")).select(
        "doc_id", "pos", T.strip(F.regexp_extract("line", r"^([^:]*):", 1)).alias("key"),
        T.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    return kv.groupBy("doc_id", "key").agg(F.max_by("value", "pos").alias("value"))


def _lines(docs: DataFrame) -> DataFrame:
    # The body is cut inside the row: a start column kept beside the generator would be
    # re-evaluated, whole text and all, for every exploded line.
    body = T.let(F.split(C.unix_newlines(F.col("text")), "\n", -1), lambda ls: T.let(
        _body_start(ls), lambda b: F.slice(ls, b + 1, F.size(ls))))
    raw = docs.select("doc_id", F.posexplode(body).alias("pos", "raw"))
    line = T.rstrip(F.col("raw"))
    marked = raw.select("doc_id", "pos", line.alias("line"),
                        F.regexp_extract(T.strip(line), PAGE_MARKER, 1).alias("_pg"),
                        F.length(F.regexp_extract(line, HEADING, 1)).alias("_lvl"),
                        T.strip(F.regexp_extract(line, HEADING, 2)).alias("_title"))
    marker = F.col("_pg") != ""
    return marked.withColumns({"page": F.when(marker, F.col("_pg").cast("int")), "is_marker": marker,
                               "is_heading": ~marker & (F.col("_lvl") > 0)})


def sections(docs: DataFrame) -> DataFrame:
    """Sections of each document (doc_id, text) in order, with path, pages and content."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(docs).withColumns({
        "section_idx": F.sum(F.col("is_heading").cast("int")).over(upto),
        "_page": F.last("page", ignorenulls=True).over(upto)}).where("section_idx > 0")
    body = ~F.col("is_marker") & ~F.col("is_heading")
    # Markers vanish, so "blank before" looks at the previous body line of the section.
    in_section = Window.partitionBy("doc_id", "section_idx", body).orderBy("pos")
    rows = rows.withColumn("_gap", F.coalesce(F.lag(F.col("line") == "").over(in_section), F.lit(False)))
    piece = F.when(body & (F.col("line") != ""), F.struct(
        "pos", F.concat(F.when(F.col("_gap"), "\n").otherwise(""), F.col("line")).alias("t")))
    heading = F.col("is_heading")
    grouped = rows.groupBy("doc_id", "section_idx").agg(
        F.max(F.when(heading, F.col("_title"))).alias("title"), F.max(F.when(heading, F.col("_lvl"))).alias("level"),
        F.max(F.when(heading, F.col("_page"))).alias("_first"), F.max_by("_page", "pos").alias("page_end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda s: s["t"]), "\n").alias("_c"))
    content = T.strip(F.col("_c"))
    flat = grouped.select(
        "doc_id", "section_idx", "title", "level", F.coalesce("_first", "page_end").alias("page_start"), "page_end",
        content.alias("content"), (content.contains("|") & content.contains("---")).alias("has_table"))
    return _with_paths(flat)


def _with_paths(secs: DataFrame) -> DataFrame:
    """Section ids, parents and paths from the last open heading of every lower level."""
    slug = T.anchor_slug(F.col("title"))
    sid = F.format_string("s%04d-%s", "section_idx", F.when(slug == "", "section").otherwise(slug))
    before = Window.partitionBy("doc_id").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = secs.withColumn("section_id", sid)
    me = F.struct("section_idx", "title", "section_id")
    for lv in range(1, 6):
        s = s.withColumn(f"_l{lv}", F.last(F.when(F.col("level") == lv, me), ignorenulls=True).over(before))
    chain = []
    for lv in range(1, 6):
        x = F.col(f"_l{lv}")
        # Open: below my level and not closed by a later heading of a lower or equal level.
        open_ = (F.lit(lv) < F.col("level")) & x.isNotNull()
        for low in range(1, lv):
            open_ = open_ & (F.coalesce(F.col(f"_l{low}.section_idx"), F.lit(0)) < x["section_idx"])
        chain.append(F.when(open_, x))
    parents = F.array_compact(F.array(*chain))
    path = F.concat(F.transform(parents, lambda p: p["title"]), F.array("title"))
    return s.select("doc_id", "section_idx", "section_id", "title", "level",
                    F.when(F.size(parents) > 0, F.element_at(parents, -1)["section_id"]).alias("parent_id"),
                    F.array_join(path, " > ").alias("path_text"), "content", "page_start", "page_end", "has_table")


def preambles(docs: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(docs).withColumn("_s", F.sum(F.col("is_heading").cast("int")).over(order)).where(
        "_s = 0 AND NOT is_marker")
    return rows.groupBy("doc_id").agg(T.strip(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")).alias("preamble"))


def structural_role(title: Column, path: Column, content: Column, page: Column, has_table: Column) -> Column:
    """Role from position and wording; the first matching rule wins."""
    t, p, c = T.strip(F.lower(T.text_or_empty(title))), F.lower(T.text_or_empty(path)), F.lower(T.text_or_empty(content))
    page = F.coalesce(page, F.lit(NO_PAGE))
    front = T.contains_any(t, vocab.ROLE_FRONTMATTER_TITLE) | T.contains_any(p, vocab.ROLE_FRONTMATTER_TITLE)
    return (F.when((page <= 8) & T.contains_any(c, vocab.ROLE_METADATA_CONTENT), "metadata")
            .when(T.contains_any(t, vocab.ROLE_METADATA_TITLE), "metadata")
            .when(p.contains("copyright") & (page <= 12), "metadata")
            .when(t.isin(*vocab.ROLE_INDEX_TITLE), "index_noise")
            .when((page >= 130) & T.contains_any(t, vocab.ROLE_INDEX_TITLE), "index_noise")
            .when(t.contains("table of contents") | (t == "contents"), "heading_overview")
            .when((page <= 30) & front, "frontmatter")
            .when(has_table, "table_data").otherwise("body"))


def quality_flags(content: Column, page: Column) -> Column:
    return F.array_compact(F.array(
        F.when(content == "", F.lit("empty_content")), F.when(F.length(content) < 80, F.lit("short_content")),
        F.when(content.contains("�"), F.lit("encoding_artifact")),
        F.when(content.contains("  "), F.lit("double_spaces")), F.when(page.isNull(), F.lit("missing_page"))))


def enrich(secs: DataFrame) -> DataFrame:
    c = F.col("content")
    return secs.withColumns({
        "char_count": F.length(c).cast("bigint"), "word_count": T.word_count(c).cast("bigint"),
        "quality_flags": quality_flags(c, F.col("page_start")),
        "structural_role": structural_role(F.col("title"), F.col("path_text"), c, F.col("page_start"),
                                           F.col("has_table"))})


def document_stats(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("doc_id").agg(
        F.count("*").alias("section_count"), F.count(F.when(F.col("has_table"), 1)).alias("sections_with_tables"),
        F.count(F.when(F.col("char_count") == 0, 1)).alias("empty_sections"))


def with_fallback_section(docs: DataFrame, secs: DataFrame) -> DataFrame:
    """Documents without headings become one section holding their preamble."""
    bare = preambles(docs).join(secs.select("doc_id").distinct(), "doc_id", "left_anti").where("preamble <> ''")
    c = F.col("preamble")
    one = bare.select(
        "doc_id", F.lit(0).cast("bigint").alias("section_idx"), F.lit("s0000").alias("section_id"), F.lit("").alias("title"),
        F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("path_text"),
        c.alias("content"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        (c.contains("|") & c.contains("---")).alias("has_table"))
    return secs.withColumn("section_idx", F.col("section_idx").cast("bigint")).unionByName(one)

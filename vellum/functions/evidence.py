"""Evidence text: wrappers removed, class and source kind assigned, report text cleaned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vellum.functions import cleaning as C, text as T, vocab

# Wrappers stripped from the front of evidence, in any order and number.
LEADING_WRAPPERS = (r"(?i)^(?:\*{0,2}\s*\(?refer to\s+(?:dmi|gmi)\s*50\s*form[^)]*\)?\s*"
                    r"|\*{0,2}\s*\[\s*table\s*\]\s*|\*{0,2}\s*agenda page \d+\s*)+")
# Mis-decoded sequences and their repair, applied in this order.
MOJIBAKE = (("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¢", "-"),
            ("Ã¢â‚¬Â¦", "..."), ("ï‚·", "-"), ("ï¬", "fi"), ("ï¬ƒ", "ffi"), ("Â§", "§"))
CROSS_REFERENCES = ("refer to", "see appendix", "see form", "good faith efforts", "gfe outreach")


def strip_html(col: Column) -> Column:
    s = F.regexp_replace(T.text_or_empty(col), r"<[^>]+>", "")
    return T.strip(F.regexp_replace(s, vocab.SPACES, " "))


def strip_wrappers(col: Column) -> Column:
    """Leading reference, table and agenda wrappers go; a run of them counts as one match."""
    return T.strip(F.regexp_replace(strip_html(col), LEADING_WRAPPERS, ""))


def normalized(col: Column) -> Column:
    return F.lower(strip_wrappers(col))


def is_appendix_or_contents(clean: Column) -> Column:
    """Clearly administrative text; ``clean`` is already stripped of wrappers.  Rules look at the opening."""
    norm, n = F.lower(clean), F.length(clean)
    head = F.substring(norm, 1, 280)
    return ((norm == "") | T.contains_any(head, ("table of contents", "revision history"))
            | (head.contains("appendix") & (n < 1200))
            | (T.contains_any(head, ("good faith efforts", "gfe outreach", "refer to dmi", "refer to gmi")) & (n < 260))
            | norm.rlike(r"^(contents|table of contents)\b"))


def evidence_class(clean: Column) -> Column:
    norm, n = F.lower(clean), F.length(clean)
    heading = (n < 90) & (clean.rlike(r"^\*{0,2}\d+(?:\.\d+){1,4}")
                          | (clean.rlike(r'^[A-Z0-9][A-Za-z0-9/&".():\- ]{2,80}$') & ~clean.contains(".")))
    return (F.when(norm == "", "heading_only")
            .when(T.contains_any(norm, vocab.APPENDIX_PHRASES) & (n < 180), "appendix_admin")
            .when(T.contains_any(norm, vocab.REFERENCE_PHRASES) & (n < 220), "reference_only")
            .when(clean.rlike(r'^\d+(?:\.\d+){1,4}\s*[A-Za-z"].{0,90}$'), "heading_only")
            .when(heading, "heading_only").otherwise("substantive"))


def source_kind(text: Column, filename: Column) -> Column:
    """Document bucket by ordered phrase rules over the file name and the whole text."""
    hay = F.regexp_replace(F.lower(F.concat(T.text_or_empty(filename), F.lit("\n"), T.text_or_empty(text))),
                           vocab.SPACES, " ")
    out = F
    for kind, any_of, groups in vocab.SOURCE_KIND_RULES:
        cond = T.contains_any(hay, any_of)
        if groups:
            both = F.lit(True)
            for g in groups:
                both = both & T.contains_any(hay, g)
            cond = cond | both
        out = out.when(cond, F.lit(kind))
    return out.otherwise("unknown")


def source_kind_label(kind: Column) -> Column:
    out = F
    for k, v in vocab.SOURCE_KIND_LABELS.items():
        out = out.when(kind == k, F.lit(v))
    return out.otherwise(vocab.SOURCE_KIND_LABELS["unknown"])


def strip_leading_artifacts(col: Column) -> Column:
    """Up to three times: drop what precedes a wide gap in the first 60 characters if it holds no real word."""
    def once(s: Column) -> Column:
        lead = F.regexp_extract(F.substring(s, 1, 60), r"^(.*?\s{2,})", 1)
        drop = (F.length(lead) > 0) & ~lead.rlike("[a-zA-Z]{5,}")
        return F.when(drop, F.substring(s, F.length(lead) + 1, F.length(s))).otherwise(s)

    return T.let(T.let(T.let(col, once), once), once)


def preview(col: Column, width: int = 0) -> Column:
    """One line without leading artifacts; cut to ``width`` characters when positive."""
    line = strip_leading_artifacts(T.strip(F.translate(T.text_or_empty(col), "\n\r", "  ")))
    if width <= 0:
        return line
    return T.let(line, lambda s: F.when(F.length(s) <= width, s).otherwise(
        F.concat(F.substring(s, 1, width), F.lit("…"))))


def clean_report_text(col: Column, strip_footers: bool = False, keep_lines: bool = False) -> Column:
    s = T.replace_literals(T.text_or_empty(col), MOJIBAKE)
    s = F.regexp_replace(s, r"(?im)^\s*Outreach\)\*\*\s*\[ TABLE \]\s*", "")
    s = F.regexp_replace(s, r"(?i)\[\s*TABLE\s*\]", "")
    if strip_footers:
        s = F.regexp_replace(s, r"(?i)\bPage\s+\d+\s+of\s+\d+\b", "")
    if keep_lines:
        s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n")
        return T.strip(F.array_join(F.transform(C.lines(s), T.rstrip), "\n"))
    return T.strip(F.regexp_replace(s, vocab.SPACES, " "))


def looks_truncated(col: Column) -> Column:
    """The text stops at an ellipsis, a dangling label, a bare bullet or heading, or mid-word."""
    v = T.rstrip(col)
    last = T.strip(F.element_at(C.lines(v), -1))
    label = v.rlike(r"\b(Source:|Figure|Appendix|Step\s+\d+|The result of these steps should look as shown in)\s*\z")
    return F.when(v == "", False).when(v.endswith("...") | v.endswith("…") | label, True).when(
        last == "", False).when(
        last.isin("*", "-", "+", "•") | last.rlike(r"^#{1,6}\s+.+\z") | last.rlike(r"^\*\*[^*]+\*\*\z"), True).when(
        last.rlike("[.!?)\\]\"'`]\\z"), False).otherwise(last.rlike(r"[A-Za-z0-9]\z"))


def shorten_block(col: Column, width: int = 1600) -> Column:
    clean = clean_report_text(col)
    return T.let(clean, lambda s: F.when(F.length(s) > width, F.concat(F.regexp_replace(
        F.substring(s, 1, width - 3), r"[ ,;:\-]+\z", ""), F.lit("..."))).otherwise(s))


def is_cross_reference(norm: Column) -> Column:
    return (norm == "") | (T.contains_any(norm, CROSS_REFERENCES) & (F.length(norm) < 180))


def pass_line(chunk_id: Column, branch: Column, kind: Column, text: Column, page: Column, filename: Column) -> Column:
    """``[chunk:id] [branch] [source:kind] text (p.N, file)``."""
    cite = F.concat_ws(", ", F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("p."), page.cast("string"))),
                       T.none_if_empty(filename))
    return F.concat_ws(" ", F.when(T.text_or_empty(chunk_id) != "", F.concat(F.lit("[chunk:"), chunk_id, F.lit("]"))),
                       F.concat(F.lit("["), branch, F.lit("]")), F.concat(F.lit("[source:"), kind, F.lit("]")), text,
                       F.when(cite != "", F.concat(F.lit("("), cite, F.lit(")"))))


PASS_LINE = r"^\[chunk:([^\]]+)\]\s+\[([^\]]+)\](?:\s+\[source:([^\]]+)\])?\s+(.*)$"


def parse_pass_line(line: Column) -> Column:
    """Struct of the fields of a pass line; NULL when the line has another shape."""
    s = T.strip(line)
    body = T.strip(F.regexp_extract(s, PASS_LINE, 4))
    cite = F.regexp_extract(body, r"\s+(\([^()]+\))$", 1)
    kind = T.strip(F.regexp_extract(s, PASS_LINE, 3))
    return F.when(s.rlike(PASS_LINE), F.struct(
        T.strip(F.regexp_extract(s, PASS_LINE, 1)).alias("chunk_id"),
        T.strip(F.regexp_extract(s, PASS_LINE, 2)).alias("branch_name"),
        F.when(kind == "", "unknown").otherwise(kind).alias("source_kind"),
        T.strip(F.regexp_replace(body, r"\s+\([^()]+\)$", "")).alias("text"),
        cite.alias("citation_suffix"), s.alias("formatted_line")))


def parse_scan_response(col: Column) -> Column:
    """Ids a selector named: bracketed ones, else bare integers; distinct, in order; NONE gives none."""
    bracketed = F.regexp_extract_all(col, F.lit(r"\[(\d+)\]"), F.lit(1))
    bare = F.regexp_extract_all(col, F.lit(r"\b(\d+)\b"), F.lit(1))
    ids = F.when(F.upper(T.strip(col)) == "NONE", F.array().cast("array<string>")).when(
        F.size(bracketed) > 0, bracketed).otherwise(bare)
    return F.array_distinct(F.transform(ids, lambda s: s.cast("bigint")))


def category_signature(names: Column) -> Column:
    clean = F.filter(F.transform(names, lambda n: F.lower(T.strip(F.regexp_replace(n, r"\s+", " ")))), lambda n: n != "")
    return F.array_join(F.array_distinct(clean), "||")


def keyword_pattern(keywords: Sequence[str], regex: bool = False) -> str:
    """One case-insensitive alternation; keywords that are not valid patterns are taken literally."""
    import re

    def part(k: str) -> str:
        if regex:
            try:
                re.compile(k)
                return k
            except re.error:
                pass
        return re.sub(r"([^\w\s])", r"\\\1", k)

    return "(?i)" + "|".join(f"(?:{part(k)})" for k in keywords if k)

"""Text repair: markdown clean-up, extraction noise, table noise, page heuristics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions import text as T, vocab

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def lines(col: Column) -> Column:
    return F.split(T.text_or_empty(col), LINE_BREAK, -1)


def unix_newlines(col: Column) -> Column:
    return F.replace(F.replace(T.text_or_empty(col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_markdown(col: Column) -> Column:
    """Repair extracted markdown: control characters, leaders, hyphen breaks, bullets, spacing."""
    s = unix_newlines(col)
    s = F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    # Only a leader at the very end of the text qualifies.
    s = F.regexp_replace(s, "(?Ud)([\\w)\\]])[\\x{FFFD}.·•]{6,}\\s*(\\d{1,4})(\\n?)\\z", "$1 ... $2$3")
    s = F.regexp_replace(s, r"\x{FFFD}{2,}", " ")
    s = F.regexp_replace(s, rf"(?U)([A-Za-z])[-\x{{AD}}]{vocab.SPACE}*\n{vocab.SPACE}*([a-z])", "$1$2")
    s = F.regexp_replace(s, rf"(?mdU)^{vocab.SPACE}*[{''.join(vocab.BULLETS)}]{vocab.SPACE}+", "- ")
    tidy = F.transform(lines(s), lambda ln: F.when(ln.startswith("```"), ln).otherwise(
        T.rstrip(F.regexp_replace(ln, r"[ \t]{2,}", " "))))
    s = F.regexp_replace(F.array_join(tidy, "\n"), r"\n\z", "")
    s = F.regexp_replace(s, r"(?md)^<!--\s*-->\s*$\n?", "")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.concat(T.strip(s), F.lit("\n"))


def repair_extraction_noise(col: Column) -> Column:
    """Undo PDF spacing in numbers, spell out math symbols, close up function calls."""
    s = F.regexp_replace(col, r"(\d)\s*,\s*(\d)", "$1,$2")
    s = F.regexp_replace(s, r"(\d)\s+\.\s+(\d)", "$1.$2")
    s = F.regexp_replace(s, r"\[(\s*\d[\d\s,.]*)\]", "($1)")
    s = F.regexp_replace(s, "[⇢←→⟵⟶↑↓⟸⟹⇐⇒➤➜]", "->")
    s = F.regexp_replace(s, "[−–—]", "-")
    s = F.regexp_replace(s, "[⇤⇥⟤⟥⌈⌉⌊⌋⟦⟧〈〉⟨⟩]", "")
    s = T.replace_literals(s, vocab.GREEK.items())
    s = F.regexp_replace(s, r"([A-Za-z_][A-Za-z0-9_]*)\s+\(\s*([^)]{0,30}?)\s*\)", "$1($2)")
    return F.regexp_replace(s, r'(?<=[\s,\-+*/=<>])"(?=[\s(])', "epsilon")


TABLE_SEPARATOR = r"\|\s*[-:]{3,}\s*\|"
BARE_PIPES = r"( *\| *){4,}"


def is_pipe_noise(col: Column) -> Column:
    """Runs of pipes, a separator next to empty cells, or two or more pipe-heavy lines."""
    def heavy(line: Column) -> Column:
        s = T.strip(line)
        pipes = F.regexp_count(s, F.lit(r"\|"))
        return (pipes >= 6) & (pipes / F.greatest(F.lit(1), F.length(s)) >= 0.4)

    return (col.rlike(r"\|{3,}") | (col.rlike(TABLE_SEPARATOR) & col.rlike(BARE_PIPES))
            | (F.size(F.filter(lines(col), heavy)) >= 2))


def strip_pipe_noise(col: Column) -> Column:
    runs_gone = F.transform(lines(col), lambda ln: F.regexp_replace(ln, r"\|{3,}", " "))
    kept = F.filter(runs_gone, lambda ln: ~(T.strip(ln).contains("|")
                                            & T.strip(ln).rlike(r"^[\s|\-:+]+$")))
    s = F.array_join(F.transform(kept, lambda ln: T.strip(F.regexp_replace(ln, r"[ \t]+", " "))), "\n")
    s = F.regexp_replace(s, TABLE_SEPARATOR, " ")
    s = F.regexp_replace(s, BARE_PIPES, " ")
    return T.strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def dotted_leader_count(col: Column) -> Column:
    """How many spaced dot leaders the text holds, by length difference over the leader length."""
    leader = ". . . . . ."
    return F.floor((F.length(col) - F.length(F.replace(col, F.lit(leader), F.lit("")))) / len(leader))


def toc_role(role: Column, text: Column) -> Column:
    return F.when((role == "body") & (dotted_leader_count(text) >= 4), F.lit("toc")).otherwise(role)


def has_math_notation(col: Column) -> Column:
    cond = F.lit(False)
    for p in vocab.MATH_PATTERNS:
        cond = cond | col.rlike(p)
    return cond


# --- page heuristics ------------------------------------------------------------
FORM_FIELDS = ("name:", "date:", "signature", "address", "phone", "email", "vendor", "bidder",
               "proposal", "submit", "contact", "form")


def collapse(col: Column) -> Column:
    return F.array_join(T.space_tokens(col), " ")


def is_contents_page(col: Column) -> Column:
    flat = F.lower(collapse(col))
    rows = F.filter(F.transform(lines(col), T.strip), lambda ln: F.length(ln) > 0)
    leaders = F.size(F.filter(rows, lambda ln: ln.rlike(r"(?:\.{3,}|_{3,}|[-·•]{3,})\s*\d{1,4}\s*$")))
    numbered = F.size(F.filter(rows, lambda ln: ln.rlike(r"^\s*\d+(?:\.\d+){0,3}\s+\S.*\d{1,4}\s*$")))
    short = F.size(F.filter(rows, lambda ln: F.length(ln) <= 120))
    n = F.size(rows)
    return (F.length(flat) > 0) & (
        flat.contains("table of contents") | flat.startswith("contents ")
        | ((n >= 5) & ((leaders >= 3)
                       | ((numbered >= 4) & (short >= F.greatest(F.lit(4), F.floor(n / 2)))))))


def is_form_page(col: Column) -> Column:
    flat = collapse(col)
    low = F.lower(flat)
    fields = sum((F.contains(low, F.lit(f)).cast("int") for f in FORM_FIELDS), F.lit(0))
    blanks = F.regexp_count(flat, F.lit(r"_{3,}|\.{4,}|□|☐|☑"))
    colons = F.length(flat) - F.length(F.replace(flat, F.lit(":"), F.lit("")))
    n = F.length(flat)
    return ((n > 0) & ~is_contents_page(col) & ~((n > 1200) & (blanks < 2))
            & ((blanks >= 3) | ((fields >= 4) & (colons >= 5) & (n <= 900))
               | ((fields >= 3) & (colons >= 6) & (n <= 650))))


def is_appendix_divider(col: Column) -> Column:
    rows = F.filter(F.transform(lines(col), T.strip), lambda ln: F.length(ln) > 0)
    flat = F.array_join(rows, " ")
    heading = flat.rlike(r"(?i)^\s*(?:appendix|exhibit|attachment|schedule)\s+[a-z0-9]+(?:\s*[:\-]\s*|\s+).+")
    return ((F.size(rows) > 0) & (F.size(rows) <= 4) & (F.length(flat) <= 180)
            & ~F.lower(flat).contains("table of contents") & heading)


# --- report text ------------------------------------------------------------------
def sentences(col: Column) -> Column:
    """Split after . ! ? followed by white space; empty pieces dropped, pieces trimmed."""
    parts = F.split(T.strip(col), rf"(?U)(?<=[.!?]){vocab.SPACE}+", -1)
    return F.filter(F.transform(parts, T.strip), lambda s: F.length(s) > 0)

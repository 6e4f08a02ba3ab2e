"""Tokenizers, set similarity and size estimates as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from vellum.functions import vocab


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def let(col: Column, fn) -> Column:
    """``fn(col)`` with ``col`` evaluated once, even where ``fn`` uses it inside a lambda.

    A lambda body re-evaluates whatever expression it mentions for every element;
    binding the value as the single element of an array avoids that.
    """
    return F.element_at(F.transform(F.array(col), fn), 1)


def find_all(col: Column, pattern: str) -> Column:
    """Every non-overlapping match of ``pattern``; NULL input gives an empty array."""
    return F.regexp_extract_all(text_or_empty(col), F.lit(pattern), F.lit(0))


def search_tokens(col: Column) -> Column:
    """Letter-first tokens of two or more characters; case is the caller's business."""
    return find_all(col, vocab.SEARCH_TOKEN)


def word_tokens(col: Column) -> Column:
    """All alphanumeric tokens, single characters and digits included."""
    return find_all(col, vocab.WORD_TOKEN)


def near_duplicate_tokens(col: Column, limit: int = 120) -> Column:
    """Lowercased word tokens; the comparison is defined on the first ``limit`` of them."""
    return F.slice(word_tokens(F.lower(text_or_empty(col))), 1, limit)


def extraction_tokens(col: Column) -> Column:
    return find_all(F.lower(text_or_empty(col)), vocab.EXTRACTION_TOKEN)


def space_tokens(col: Column) -> Column:
    """Runs of non-white-space characters (Unicode white space)."""
    return find_all(col, vocab.NON_SPACES)


def word_count(col: Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(vocab.NON_SPACES))


# The characters of vocab.SPACE, for the native trims.
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text_or_empty(col), F.lit(SPACE_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(text_or_empty(col), F.lit(SPACE_CHARS))


def lstrip(col: Column) -> Column:
    return F.ltrim(text_or_empty(col), F.lit(SPACE_CHARS))


def none_if_empty(col: Column) -> Column:
    """Absent-or-empty strings count as missing in every fallback chain."""
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[none_if_empty(c) for c in cols])


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two token arrays: 1 when both are empty, 0 when one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def estimate_tokens(col: Column) -> Column:
    """Token estimate: the larger of 1.3 x words and characters / 3, at least 1; 0 when blank."""
    by_chars = F.floor(F.length(col) / 3).cast("int")
    return let(word_count(col), lambda words: F.when(words == 0, F.lit(0)).otherwise(
        F.greatest(F.floor(words * F.lit(1.3)).cast("int"), by_chars, F.lit(1))))


def path_slug(col: Column) -> Column:
    s = F.regexp_replace(F.lower(text_or_empty(col)), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(s, r"(?U)[\s_-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit("branch")).otherwise(s)


def anchor_slug(col: Column) -> Column:
    s = F.regexp_replace(F.lower(text_or_empty(col)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(s, r"^-+|-+$", "")


def word_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def contains_any(col: Column, phrases: Iterable[str]) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | F.contains(col, F.lit(p))
    return cond


def has_any_token(tokens: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(tokens, word_array(words))


def content_terms(tokens: Column, stopwords: Iterable[str], longer_than: int) -> Column:
    """Tokens outside ``stopwords`` with more than ``longer_than`` characters."""
    stop = list(stopwords)
    return F.filter(tokens, lambda t: (~t.isin(stop)) & (F.length(t) > longer_than))


def term_variants(term: Column) -> Column:
    """Crude stems tried when looking a term up in text: -ies/-y, -s, -ing, -ed."""
    n = F.length(term)
    return F.array_compact(F.array(
        term,
        F.when(term.endswith("ies") & (n > 4), F.concat(F.substring(term, 1, n - 3), F.lit("y"))),
        F.when(term.endswith("s") & (n > 4), F.substring(term, 1, n - 1)),
        F.when(term.endswith("ing") & (n > 5), F.substring(term, 1, n - 3)),
        F.when(term.endswith("ed") & (n > 4), F.substring(term, 1, n - 2)),
    ))


def term_in_text(term: Column, text_lower: Column) -> Column:
    return F.exists(term_variants(term), lambda v: F.contains(text_lower, v))


def initials(tokens: Column) -> Column:
    """Upper-cased first letters of the significant words of a phrase."""
    keep = F.filter(tokens, lambda w: (F.length(w) > 1)
                    & ~F.lower(w).isin(vocab.QUERY_STOPWORDS))
    return F.array_join(F.transform(keep, lambda w: F.upper(F.substring(w, 1, 1))), "")


def acronym_fits(acronym: Column, phrase_tokens: Column) -> Column:
    return initials(phrase_tokens).endswith(F.upper(acronym))


def low_value(col: Column) -> Column:
    """Fragments with fewer than 4 words or fewer than 3 alphabetic runs of 3+ letters."""
    return (word_count(col) < 4) | (F.regexp_count(text_or_empty(col), F.lit("[a-zA-Z]{3,}")) < 3)


def preview(col: Column, width: int = 150) -> Column:
    """Display snippet: the first ``width`` characters, right-trimmed, always followed by an ellipsis."""
    return F.when(F.coalesce(F.length(col), F.lit(0)) == 0, F.lit("")).otherwise(
        F.concat(rstrip(F.substring(col, 1, width)), F.lit("…")))


def replace_literals(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col

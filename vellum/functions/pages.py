"""HTML pages and web results: visible text, link hygiene, result screening."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from vellum.functions import text as T, vocab

SCRIPT_STYLE = r"(?is)<(script|style)[^>]*>.*?</\1>"
MAIN_CONTENT = r"(?is)<(?:main|article)(?:\s[^>]*)?>(.+?)</(?:main|article)>"
NAVIGATION = r"(?is)<(?:nav|header|footer|aside)(?:\s[^>]*)?>.*?</(?:nav|header|footer|aside)>"
# Phrases of navigation noise.
LOW_VALUE_PHRASES = (
    "table of contents", "quick summary", "ask anything", "top questions", "external websites",
    "submit feedback", "edit links", "related changes", "permanent link", "page information",
    "printable version", "wikidata item")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape_entities(col: Column) -> Column:
    """Resolve HTML entities; texts without an ampersand never leave the JVM."""
    needs = F.contains(col, F.lit("&"))
    return F.coalesce(_unescape(F.when(needs, col)), col)


def markup_to_text(col: Column) -> Column:
    """Drop scripts, prefer main/article content, else drop navigation; strip the tags."""
    s = F.regexp_replace(T.text_or_empty(col), SCRIPT_STYLE, " ")
    main = F.regexp_extract(s, MAIN_CONTENT, 1)
    s = F.when(F.length(main) > 0, main).otherwise(F.regexp_replace(s, NAVIGATION, " "))
    return F.regexp_replace(s, r"<[^>]+>", " ")


def visible_text(col: Column) -> Column:
    s = unescape_entities(markup_to_text(col))
    return T.strip(F.regexp_replace(s, vocab.SPACES, " "))


def low_quality(col: Column) -> Column:
    """Navigation or list noise: two stock phrases, many non-ASCII characters, or no sentences."""
    low = F.lower(col)
    hints = sum((F.contains(low, F.lit(p)).cast("int") for p in LOW_VALUE_PHRASES), F.lit(0))
    foreign = F.regexp_count(col, F.lit(r"[^\x00-\x7F]")) / F.length(col)
    prose = F.size(F.filter(F.split(col, r"\. ", -1), lambda s: F.length(T.strip(s)) > 20))
    return (F.length(col) >= 80) & ((hints >= 2) | (foreign > vocab.WEB["max_non_ascii"])
                                    | ((F.length(col) > 400) & (prose < 2)))


def host(url: Column) -> Column:
    """Network location of a URL: what follows ``//`` up to the path, query or fragment."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def normalize_url(href: Column) -> Column:
    """Absolute http(s) URL, redirect wrappers opened; '' for anything else or a search host."""
    h = T.strip(unescape_entities(href))
    h = F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h)
    target = F.regexp_extract(h, r"uddg=([^&]+)", 1)
    h = F.when(h.contains("/l/") & (F.length(target) > 0),
               F.url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))).otherwise(h)
    bad = ~h.rlike(r"^(?i:https?)://") | T.contains_any(host(h), ("duckduckgo.com", "bing.com"))
    return F.when(bad, F.lit("")).otherwise(h)


def low_value_result(url: Column, title: Column) -> Column:
    t = F.lower(title)
    return (T.contains_any(host(url), vocab.LOW_VALUE_DOMAINS)
            | T.contains_any(F.lower(url_path(url)), vocab.LOW_VALUE_PATHS)
            | t.contains("definition") | t.contains("meaning"))


def domain_preference(url: Column) -> Column:
    h = host(url)
    return (T.contains_any(h, vocab.PREFERRED_DOMAINS).cast("int")
            - T.contains_any(h, vocab.DEMOTED_DOMAINS).cast("int"))


def cjk_share(col: Column) -> Column:
    n = F.regexp_count(col, F.lit(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"))
    return n / F.greatest(F.length(col), F.lit(1))

"""What kind of question a query is, as boolean Column expressions over its text.

The three external-fact tests differ on purpose: retrieval, web fallback and
answer coverage each have their own notion, and results depend on which is used.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions import text as T, vocab

# Phrasings of a request for an overview.
OVERVIEW_PHRASES = (
    r"\bwhat\s+(is|does)\s+(this|the)\s+\w+\s+about\b",
    r"\bwhat\s+is\s+this\s+about\b",
    r"\bwhat\s+is\b.{1,80}\babout\b",
    r"\bwhat\s+does\s+(this|the)\s+\w+\s+cover\b",
    r"\b(summarize|summarise)\b",
    r"\bgive\s+(me|us)\s+(a|an)\s+(brief\s+)?(summary|overview|synopsis)\b",
    r"\boverview\s+of\b",
    r"\bwhat\s+topics\b",
    r"\bwhat\s+is\s+covered\b",
    r"\bdescribe\s+(this|the)\s+(book|document|paper|article|chapter|text)\b",
    r"\btell\s+(me|us)\s+about\s+(this|the)\s+(book|document|paper|article|chapter|text)\b",
)
BROAD_REQUEST = r"\b(explain|summary|summarize|overview|describe|in\s+detail)\b"


def _tokens(q: Column) -> Column:
    return T.search_tokens(T.strip(q))


def _lower(q: Column) -> Column:
    return F.transform(_tokens(q), F.lower)


def _first(q: Column) -> Column:
    return F.coalesce(F.get(_lower(q), F.lit(0)), F.lit(""))


def _has(q: Column, words) -> Column:
    return T.has_any_token(_lower(q), words)


def _upper(tok: Column) -> Column:
    return (F.upper(tok) == tok) & tok.rlike("[A-Z]")


def _tail(q: Column) -> Column:
    t = _tokens(q)
    return F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))


def _proper_noun(q: Column) -> Column:
    return F.exists(_tail(q), lambda t: t.rlike("^[A-Z]") & ~_upper(t))


def is_metadata(q: Column) -> Column:
    return _has(q, vocab.METADATA_TERMS)


def is_numeric(q: Column) -> Column:
    return T.text_or_empty(q).rlike("[0-9]") | (_has(q, vocab.NUMERIC_TERMS) & _has(q, vocab.NUMERIC_TRIGGERS))


def is_overview_terms(q: Column) -> Column:
    hits = F.array_intersect(F.array_distinct(_lower(q)), T.word_array(vocab.OVERVIEW_TERMS))
    return F.size(hits) >= 2


def is_overview_request(q: Column) -> Column:
    return T.strip(q).rlike("(?i)" + "|".join(OVERVIEW_PHRASES))


def is_broad_request(q: Column) -> Column:
    return F.lower(T.text_or_empty(q)).rlike(BROAD_REQUEST)


def is_external_fact(q: Column) -> Column:
    """Retrieval's notion: fact openers with an entity or date; news words anywhere."""
    opener, news = _first(q), _has(q, vocab.NEWS_TERMS)
    recency = _has(q, vocab.RECENCY_TERMS)
    entity = F.exists(_tokens(q), lambda t: _upper(t))
    fact = T.strip(q).rlike(vocab.YEAR) | entity | _proper_noun(q) | recency
    what = _has(q, vocab.STRONG_RECENCY_TERMS) | news | (_proper_noun(q) & _has(q, vocab.RELEASE_VERBS))
    return F.when(F.size(_tokens(q)) == 0, False).when(
        opener.isin(vocab.FACT_OPENERS), fact).when(opener == "what", what).when(
        opener.isin(vocab.INFORMATIONAL_OPENERS), recency | news).otherwise(news)


def is_external_fact_for_web(q: Column) -> Column:
    """Web fallback's notion: its own shorter news and recency lists; biographical terms and, after
    'what', years count."""
    opener, news = _first(q), _has(q, vocab.WEB_NEWS_TERMS)
    recency, bio = _has(q, vocab.WEB_RECENCY_TERMS), _has(q, vocab.BIOGRAPHICAL_TERMS)
    year = T.strip(q).rlike(vocab.YEAR)
    entity = F.exists(_tokens(q), lambda t: _upper(t))
    fact = year | entity | _proper_noun(q) | recency | bio
    what = recency | news | bio | year | (_proper_noun(q) & _has(q, vocab.RELEASE_VERBS))
    return F.when(F.size(_tokens(q)) == 0, False).when(
        opener.isin(vocab.FACT_OPENERS), fact).when(opener == "what", what).when(
        opener.isin(vocab.INFORMATIONAL_OPENERS), recency | news).otherwise(news)


def is_external_fact_for_coverage(q: Column) -> Column:
    """Answer coverage's notion: an opener plus a year, 'current' or a capitalised term."""
    entity = F.exists(_tail(q), lambda t: _upper(t) | (
        t.rlike("^[A-Z]") & (F.length(t) >= 3) & ~F.lower(t).isin(vocab.ANSWER_STOPWORDS)))
    hint = T.strip(q).rlike(vocab.YEAR) | _has(q, ["current"]) | entity
    return (F.size(_tokens(q)) > 0) & _first(q).isin(vocab.COVERAGE_FACT_OPENERS) & hint


def is_factoid(q: Column) -> Column:
    n = F.size(_lower(q))
    return (F.length(T.strip(q)) > 0) & (
        (_first(q).isin(vocab.FACTOID_OPENERS) & (n <= 14)) | _has(q, vocab.FACTOID_HINTS)
        | ((n <= 8) & T.strip(q).endswith("?")))


def is_metadata_fact(q: Column) -> Column:
    return _has(q, vocab.METADATA_FACT_HINTS)


# --- decomposition of comparisons ---------------------------------------------------
# Sub-topic patterns, most specific first, and fragments too vague to search for.
SUB_TOPIC_PATTERNS = (
    (r"(?i)\bcompare\s+(.+?)\s+(?:and|with|to|versus|vs\.?)\s+(.+?)(?:\?|$)", (1, 2)),
    (r"(?i)(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)", (1, 2)),
    (r"(?i)\bdifferences?\s+between\s+(.+?)\s+and\s+([^,?]+?)(?:[,?]|$)", (1, 2)),
    (r"(?i)\bhow\s+(?:does\s+(.+?)\s+differ\s+from\s+(.+?)|do\s+(.+?)\s+and\s+(.+?)\s+differ)(?:\?|$)",
     (1, 2, 3, 4)),
    (r"(?i)^(?:what\s+(?:is|are)|explain|describe|define)\b.+?\b(.{4,40}?)\s+and\s+(.{4,40})(?:\?|$)",
     (1, 2)),
)
VAGUE_FRAGMENTS = ("them", "they", "it", "these", "those", "this", "that", "the two", "both", "each",
                   "either", "the difference")
QUESTION_OPENER = r"(?i)^(what\s+is|what\s+are|how\s+does|how\s+do|explain|describe|define)\b"


def sub_topics(q: Column, most: int = 3) -> Column:
    """Topics a comparison names: the first pattern yielding two usable ones wins, else none."""
    out = None
    for pattern, groups in SUB_TOPIC_PATTERNS:
        parts = F.array(*[F.regexp_extract(q, pattern, g) for g in groups])
        clean = F.transform(parts, lambda s: T.strip(F.regexp_replace(
            F.regexp_replace(T.strip(s), r"[?.!,;]+$", ""), r"(?i)^(?:the|a|an)\s+", "")))
        good = F.filter(clean, lambda s: (F.length(s) >= 2) & ~F.lower(s).isin(list(VAGUE_FRAGMENTS)))
        found = F.size(good) >= 2
        out = F.when(found, good) if out is None else out.when(found, good)
    return F.slice(out.otherwise(F.array().cast("array<string>")), 1, most)


def sub_query(q: Column, topic: Column, topics: Column) -> Column:
    """A focused query for one topic, keeping the opener and, for pairs, naming the sibling."""
    opener = F.regexp_extract(q, QUESTION_OPENER, 1)
    opener = F.when(F.length(opener) == 0, F.lit("what is")).otherwise(opener)
    others = F.filter(topics, lambda t: F.lower(t) != F.lower(topic))
    sibling = F.get(others, F.lit(0))
    base = F.concat(opener, F.lit(" "), topic)
    return F.when(T.word_count(topic) > 6, topic).when(
        (F.size(topics) == 2) & sibling.isNotNull() & (T.word_count(sibling) <= 4),
        F.concat(base, F.lit(" versus "), sibling)).otherwise(base)

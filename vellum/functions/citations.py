"""Citation tags: short forms, clean-up, sentence-level enforcement, fact checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions import cleaning as C, text as T, vocab

# Citation noise produced by models.
NOISE = (r"(?i)\[chunk_id\]", r"(?i)\[chunk_[^\]]+\]", r"(?i)\[CHUNK\s+[^\]]+\]", r"(?i)\[chunk_id\s+[^\]]+\]",
         r"(?i)\(chunk[^)]*\)", r"(?i)chunk_[0-9a-f\-]+", r"(?i)chunk\s+[0-9a-f]{24,}[-a-z0-9]*",
         r"(?i)\b(?:CH|c)[0-9a-f]{12,}(?:-c\d{1,6})?\b", r"(?i)\bc\d{7,}\b")
BRACKETED = r"\[[^\[\]]+\]"
# Words ignored when weighing a sentence, and non-entities.
GROUNDING_NON_ENTITIES = ("citations", "chapter", "part")


def short_citation(chunk_id: Column) -> Column:
    """c + six digits when the id carries an index, else its last 12 characters, else 'unknown'."""
    suffix = F.regexp_extract(chunk_id, r"-c(\d{6})$", 1)
    loose = F.regexp_extract(chunk_id, r"(?i)\bc(\d{1,6})\b", 1)
    return (F.when(T.text_or_empty(chunk_id) == "", "unknown").when(suffix != "", F.concat(F.lit("c"), suffix))
            .when(loose != "", F.concat(F.lit("c"), F.lpad(loose, 6, "0")))
            .otherwise(F.when(F.length(chunk_id) <= 12, chunk_id).otherwise(F.substring(chunk_id, -12, 12))))


def strip_citation_block(answer: Column) -> Column:
    """Everything before a trailing 'Citations:' line."""
    return T.strip(F.element_at(F.split(T.strip(answer), r"(?i)\n\s*Citations\s*:\s*", 2), 1))


def normalize_answer(answer: Column, tags: Column) -> Column:
    """Drop malformed citations, close up spacing, append the citation list (array of tags)."""
    s = T.text_or_empty(answer)
    for p in NOISE:
        s = F.regexp_replace(s, p, "")
    s = F.regexp_replace(s, r"\[\s*\]", "")
    s = F.regexp_replace(s, r"(?i)\[(?!c\d{6}\])[^\[\]]{1,140}\]", "")
    s = F.regexp_replace(s, r"\s+([,.;:!?])", "$1")
    s = F.regexp_replace(s, r"\s{2,}", " ")
    s = T.strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))
    return F.when(F.size(tags) == 0, s).otherwise(F.concat(s, F.lit("\n\nCitations: "), F.array_join(
        F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))), ", ")))


def is_factual(sentence: Column) -> Column:
    return (F.size(T.search_tokens(F.lower(sentence))) >= 5) | sentence.rlike(r"\d")


def cite_sentences(answer: Column, tag: Column) -> tuple[Column, Column]:
    """(answer with the default tag on every uncited factual sentence, number added)."""
    sents = C.sentences(strip_citation_block(answer))

    def lacks(s: Column) -> Column:
        return is_factual(s) & ~s.rlike(BRACKETED)

    tagged = F.transform(sents, lambda s: F.when(lacks(s), F.concat(s, F.lit(" ["), tag, F.lit("]"))).otherwise(s))
    return F.array_join(tagged, " "), F.size(F.filter(sents, lacks))


def normalize_for_facts(col: Column) -> Column:
    s = F.regexp_replace(col, r"(\d)\s*%", "$1 percent")
    return F.lower(F.regexp_replace(s, r"(\d)\s*,\s*(\d)", "$1,$2"))


def has_fact(answer: Column, fact: Column) -> Column:
    """A fact holds when any of its ``|`` separated alternatives occurs in the answer."""
    alts = F.split(fact, r"\|", -1)
    return T.let(normalize_for_facts(answer), lambda a: F.exists(alts, lambda x: F.contains(a, normalize_for_facts(x))))


def excerpt(text: Column, width: int) -> Column:
    s = T.strip(text)
    return F.when(F.length(s) > width, F.concat(T.rstrip(F.substring(s, 1, width)), F.lit(" ..."))).otherwise(s)


def malformed_citations(answer: Column) -> Column:
    return F.regexp_count(answer, F.lit(r"(?i)\bc[0-9a-f]{20,}\b|\bc\d{7,}\b|\[ch[a-z0-9_-]{6,}\]"))


ENTITY = r"(?U)\b(?:[A-Z][a-z]{2,}|[A-Z]{2,10})\b"


def entities(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(T.text_or_empty(answer), F.lit(ENTITY), F.lit(0))))


def stop_terms(col: Column) -> Column:
    """Content terms used by coverage checks."""
    return T.content_terms(T.search_tokens(F.lower(T.text_or_empty(col))),
                           sorted(set(vocab.ANSWER_STOPWORDS) | set(vocab.COVERAGE_STOPWORDS)), 2)


# Words left out when a sentence's support is weighed.
GROUNDING_STOPWORDS = (
    "the a an and or but if then else for to of in on at by with from as is are was were be been being "
    "this that these those it its into over under than can could should would may might very more most "
    "less least not no yes do does did done have has had").split()

"""Intent blending, source planning and document scoping for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import text as T

NLI_SHARE, EXAMPLE_SHARE = 0.6, 0.4
INTENT_FLOOR, SECOND_GAP = 0.65, 0.15

# Cues that a question is about the documents, and small talk.
DOC_CUES = (
    r"(?i)\b(?:document|docs?|pdf|file|files|report|spec|specification|rfq|appendix|drawing|drawings)\b",
    r"(?i)\b(?:collection|uploaded files?|uploaded docs?|my files?|my docs?|knowledge base|evidence)\b",
    r"(?i)\b(?:what does (?:the|this|that|my)?\s*(?:document|doc|spec|report|pdf|rfq)\s+say|"
    r"check (?:the|this|that|my)?\s*(?:document|doc|spec|report|pdf|rfq)|"
    r"show me (?:the )?evidence|according to (?:the|this|that|my)?\s*(?:document|doc|spec|report|pdf|rfq))\b",
)
SMALL_TALK = r"(?i)^\s*(?:hi|hello|hey|thanks|thank you|thx|ok(?:ay)?|cool|sounds good|goodnight|bye)\W*\s*$"
FACTUAL_INTENTS = ("metadata_lookup", "formula_lookup", "section_lookup", "comparison", "list_lookup", "summary",
                   "fact_lookup", "exploratory", "implicit_followup")
SKIP_INTENTS = ("conversational_meta", "conversational", "user_profile")
# Fixed values: (top_k, candidate_k) per intent where they differ from (5, 40).
DEPTHS = {"metadata_lookup": (5, 20), "fact_lookup": (10, 50), "exploratory": (10, 60)}
TITLE_STOPWORDS = (
    "a an the and or of in to for with by on at from as is it its their this that which what how who s "
    "introduction advanced topics foundations concepts approach modern adaptive computation series").split()
SCOPE_MENTION = (r"(?i)^(?:according\s+to|as\s+(?:described|stated|discussed|explained|defined)\s+in|based\s+on\s+(?:the\s+)?)\s+"
                 r"(.+?)(?:\s+(?:textbook|book|text))?\s*[,;]")
#: Parts of the titles that share a set of words, each joined by itself.
SLOTS = 16
SCOPE_ACRONYM = r"^[Ii]n\s+([A-Z]{2,}(?:\s+[A-Z]{2,})*)\b"


def example_votes(similarities: DataFrame) -> DataFrame:
    """(query_id, label, vote): best similarity per label, scaled so a query's best label has 1."""
    best = similarities.groupBy("query_id", "label").agg(F.max("similarity").alias("best"))
    top = best.groupBy("query_id").agg(F.max("best").alias("top"))
    return best.join(top, "query_id").select("query_id", "label", F.when(
        F.col("top") > 0, F.col("best") / F.col("top")).otherwise(F.col("best")).alias("vote"))


def blended_intent(votes: DataFrame, classifier: DataFrame) -> DataFrame:
    """(query_id, label, score): classifier scores and example votes blended, best label wins."""
    j = votes.join(classifier, ["query_id", "label"], "full")
    s = NLI_SHARE * F.coalesce("score", F.lit(0.0)) + EXAMPLE_SHARE * F.coalesce("vote", F.lit(0.0))
    b = j.select("query_id", "label", F.round(s, 6).alias("blended"))
    return b.groupBy("query_id").agg(F.max("blended").alias("blended"), F.min_by("label", F.struct(-F.col("blended"), "label")).alias("label"))


def zero_shot(classifier: DataFrame) -> DataFrame:
    """Primary label when confident, secondary when it follows closely."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    two = classifier.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    g = two.groupBy("query_id").agg(pick(1, "label").alias("l1"), pick(1, "score").alias("s1"),
                                    pick(2, "label").alias("l2"), pick(2, "score").alias("s2"))
    return g.select("query_id", F.when(F.col("s1") >= INTENT_FLOOR, F.col("l1")).alias("primary"), F.when(
        F.round(F.col("s1") - F.col("s2"), 9) <= SECOND_GAP, F.col("l2")).alias("secondary"))


def document_cues(q: Column) -> Column:
    return sum((q.rlike(p).cast("int") for p in DOC_CUES), F.lit(0))


def source_scores(q: Column, intent: Column, needs_web: Column, collection: Column, doc_filter: Column,
                  rag_recent: Column, web_recent: Column) -> dict[str, Column]:
    """Integer evidence for answering from documents, the web or the conversation."""
    cues = document_cues(q) > 0

    def pts(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    scoped = collection | doc_filter | cues | (rag_recent > 0)
    talk = q.rlike(SMALL_TALK)
    rag = (pts(collection, 4) + pts(doc_filter, 5) + pts(cues, 4)
           + F.when(rag_recent > 0, F.least(F.lit(4), rag_recent + 1)).otherwise(0)
           + pts(intent.isin(*FACTUAL_INTENTS) & scoped, 2))
    web = (F.when((web_recent > 0) & needs_web, F.least(F.lit(4), web_recent + 1)).otherwise(0)
           + pts(needs_web, 6) + pts(intent == "current_data_lookup", 3))
    chat = (pts(cues, -4) + pts(needs_web, -3) + F.when(intent.isin("conversational_meta", "user_profile"), 6)
            .when(intent == "conversational", 4).otherwise(0) + pts(talk, 4))
    return {"rag": rag, "web": web, "chat": chat}


def web_first(q: Column, needs_web: Column) -> Column:
    return needs_web & (document_cues(q) == 0)


def strategy(intent: Column) -> tuple[Column, Column]:
    """(top_k, candidate_k) of an intent."""
    k, c = F.lit(5), F.lit(40)
    for name, (a, b) in DEPTHS.items():
        k, c = F.when(intent == name, a).otherwise(k), F.when(intent == name, b).otherwise(c)
    return k, c


def title_tokens(name: Column) -> Column:
    """Distinct lower-case words of a title, CamelCase taken apart, stop words out."""
    camel = F.regexp_extract_all(name, F.lit(r"[A-Z][a-z]+|[A-Z]+(?=[A-Z][a-z])|[A-Z]+$|[a-z]+"), F.lit(0))
    plain = F.regexp_extract_all(name, F.lit(r"[a-zA-Z]+"), F.lit(0))
    words = F.transform(F.filter(F.concat(camel, plain), lambda w: F.length(w) > 1), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(TITLE_STOPWORDS)))


def mentioned_title(q: Column) -> Column:
    m = F.regexp_extract(T.strip(q), SCOPE_MENTION, 1)
    return F.when(m != "", T.strip(m)).otherwise(F.regexp_extract(T.strip(q), SCOPE_ACRONYM, 1))


def _word_sets(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (``key``, words) as (key, words, copies): keys with one set of words, and keys with several or null."""
    sets = rows.where(F.size("words") > 0).groupBy(key, F.sort_array("words").alias("words")).agg(F.count("*").alias("copies"))
    several = sets.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    whole = sets.where(F.col(key).isNotNull())
    return whole.join(several, key, "left_anti"), whole.join(several, key, "left_semi").unionByName(sets.where(F.col(key).isNull()))


def _by_word(sets: DataFrame, key: str) -> DataFrame:
    """(key, n, word, copies): the words of sets, with the size of their set."""
    return sets.select(key, F.size("words").alias("n"), "copies", F.explode("words").alias("word")).groupBy(
        key, "n", "word").agg(F.sum("copies").alias("copies"))


def _overlaps(queries: DataFrame, titles: DataFrame, q: str, t: str) -> DataFrame:
    """(q, t, score) of sets of words that share enough of them; repeated rows count as often as they occur."""
    met = _by_word(queries, q).withColumnRenamed("copies", "_cq").join(
        _by_word(titles, t).select(t, "word", F.col("copies").alias("_ct")), "word")
    return met.groupBy(q, t).agg((F.sum(F.col("_cq") * F.col("_ct")) / F.max("n")).alias("score")).where("score >= 0.5")


def scoped_documents(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): documents whose title shares at least half the mention's words, near the best.

    Equal mentions and equal titles are one set of words each: sets meet in an equi-join on the word, only overlaps
    are counted, and ids come back to the sets that are near the best.  Ids with several sets of words go by themselves.
    """
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(
        F.regexp_replace(mentioned_title(F.col("query")), r"'s\b", ""), F.lit("[a-zA-Z]+"), F.lit(0)), F.lower),
        lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOPWORDS)))
    caps = F.regexp_extract(T.strip(F.col("query")), SCOPE_MENTION, 1) == ""
    single = mentioned_title(F.col("query")).rlike("^[A-Z][a-zA-Z0-9]*$")
    q = queries.select("query_id", words.alias("words"), (caps | single).alias("one_ok")).where(
        (F.size("words") >= 2) | ((F.size("words") == 1) & F.col("one_ok")))
    one, many = _word_sets(q.select("query_id", "words"), "query_id")
    plain, odd = _word_sets(titles.select("doc_id", title_tokens(F.col("title")).alias("words")), "doc_id")
    q_set, t_set = F.struct("words", "copies").alias("q_set"), F.struct("words", "copies").alias("t_set")
    one, plain = one.select("query_id", q_set, "words", "copies"), plain.select("doc_id", t_set, "words", "copies")
    of_sets = _overlaps(one.select("q_set", "words", "copies").distinct(), plain.select("t_set", "words", "copies").distinct(), "q_set", "t_set")
    of_ids = _overlaps(many, odd.unionByName(plain.drop("t_set")), "query_id", "doc_id").unionByName(
        _overlaps(one, odd, "query_id", "doc_id"))
    near = of_sets.join(of_sets.groupBy("q_set").agg(F.max("score").alias("top")), "q_set").where(
        F.col("score") >= F.col("top") - 0.10 - 1e-12)
    ours = one.select("query_id", "q_set").join(near, "q_set")
    best = ours.select("query_id", "score").unionByName(of_ids.select("query_id", "score")).groupBy("query_id").agg(F.max("score").alias("best"))
    enough = F.col("score") >= F.col("best") - 0.10 - 1e-12
    found = ours.join(best, "query_id").where(enough).select("query_id", "t_set", "score")
    # The rows are few before they meet and many after: titles of a set are dealt over slots and partitions are not merged.
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).repartition(parts, "t_set", "slot")
    titled = plain.select("doc_id", "t_set", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")).repartition(parts, "t_set", "slot")
    return found.join(titled, ["t_set", "slot"]).select("query_id", "doc_id", "score").unionByName(
        of_ids.join(best, "query_id").where(enough).select("query_id", "doc_id", "score"))


def registry_entry(filename: Column, metadata: Column) -> dict[str, Column]:
    """Title, authors, publisher and year from metadata, else from ``Authors - Title (Year, Publisher)``."""
    def meta(*keys: str) -> Column:
        return F.coalesce(*[T.none_if_empty(F.trim(F.get_json_object(metadata, f"$.{k}"))) for k in keys])

    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"( - libgen\.(?:li|is|rs))+$", "")
    pat = r"\(((?:19|20)\d{2})(?:,\s*([^)]+))?\)"
    rest = F.regexp_replace(F.regexp_replace(stem, pat, ""), r"^[ \-_]+|[ \-_]+$", "")
    parts = F.filter(F.transform(F.split(rest, " - ", -1), lambda p: F.trim(p)), lambda p: p != "")
    many = F.size(parts) >= 2
    title = F.when(many, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " - ")).otherwise(F.get(parts, F.lit(0)))
    return {"title": F.coalesce(meta("title", "document_title"), T.none_if_empty(title), stem),
            "authors": F.coalesce(meta("author", "authors"), F.when(many, F.get(parts, F.lit(0)))),
            "publisher": F.coalesce(meta("publisher"), T.none_if_empty(F.trim(F.regexp_extract(stem, pat, 2)))),
            "year": F.coalesce(meta("year", "publication_year"), T.none_if_empty(F.regexp_extract(stem, pat, 1)))}

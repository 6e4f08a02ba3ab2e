"""Score adjustments, bonuses and decision rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions import queries as Q, text as T, vocab

SUMMARY_ROLES = ("document_summary", "page_range_summary")


def structural_role_score(role: Column, tokens: Column, page: Column, meta_q: Column, overview_q: Column,
                          numeric_q: Column) -> Column:
    """Adjustment by structural role and query kind, plus the penalty for near-empty stubs."""
    role = F.coalesce(role, F.lit("body"))
    page = F.when(F.coalesce(page, F.lit(0)) == 0, F.lit(-1)).otherwise(page)
    zero = F.lit(0.0)
    by_meta = (F.when(role == "metadata", 0.60).when(role == "frontmatter", 0.08).when(role == "toc", 0.25)
               .when(role.isin("index_noise", "body", "table_data", "heading_overview"), -0.20).otherwise(zero))
    by_overview = (F.when(role.isin(*SUMMARY_ROLES), 0.25).when(role == "heading_overview", 0.20)
                   .when(role == "frontmatter", 0.12).when(role == "toc", 0.15)
                   .when((role == "body") & (page > 30), -0.06).otherwise(zero))
    by_content = (F.when(role.isin(*SUMMARY_ROLES), -0.15).when(role == "metadata", -0.12)
                  .when(role == "index_noise", -0.08).when(role == "toc", -0.30)
                  .when((role == "table_data") & ~numeric_q, -0.06)
                  .when((role == "frontmatter") & (page <= 20), -0.04).otherwise(zero))
    stub = F.when((tokens > 0) & (tokens < 20), -0.20).otherwise(zero)
    return F.when(meta_q, by_meta).when(overview_q, by_overview).otherwise(by_content) + stub


def header_blob(title: Column, path: Column, text: Column) -> Column:
    return F.lower(F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(path), T.text_or_empty(text)))


def contained(terms: Column, blob: Column) -> Column:
    """How many entries of ``terms`` occur in ``blob`` as substrings."""
    return T.let(blob, lambda b: F.size(F.filter(terms, lambda t: F.contains(b, t))))


def query_overlap_bonus(query: Column, blob: Column) -> Column:
    terms = F.array_distinct(T.content_terms(T.search_tokens(F.lower(query)), vocab.QUERY_STOPWORDS, 3))
    return F.least(contained(terms, blob) * 0.015, F.lit(0.10))


def rerank_score(vector_score: Column, query: Column, text: Column, title: Column, path: Column,
                 tokens: Column, has_table: Column | None = None, alpha_vector: float | None = None,
                 alpha_lexical: float | None = None, prefer_tables: bool = False,
                 prefer_shorter: bool = False) -> Column:
    """Blend of vector score and lexical Jaccard with keyword, header, phrase and length terms."""
    p = vocab.RERANK
    av = p["alpha_vector"] if alpha_vector is None else alpha_vector
    al = p["alpha_lexical"] if alpha_lexical is None else alpha_lexical
    q_tok, t_tok = T.search_tokens(F.lower(query)), T.search_tokens(F.lower(text))
    q_set, t_set = F.array_distinct(q_tok), F.array_distinct(t_tok)
    h_set = F.array_distinct(T.search_tokens(F.lower(F.concat_ws(
        " ", T.text_or_empty(title), T.text_or_empty(path)))))
    inter = F.size(F.array_intersect(q_set, t_set))
    union = F.size(q_set) + F.size(t_set) - inter
    jac = F.when(union == 0, F.lit(1.0)).otherwise(inter / F.greatest(union, F.lit(1)))
    keyword = F.least(F.lit(p["keyword_cap"]), inter * p["keyword_per_match"])
    header = F.least(F.lit(p["header_cap"]), F.size(F.array_intersect(q_set, h_set)) * p["header_per_match"])
    phrase = F.when((F.size(q_set) >= 2) & F.contains(F.array_join(t_tok, " "), F.array_join(q_tok, " ")),
                    F.lit(p["phrase_bonus"])).otherwise(F.lit(0.0))
    out = av * vector_score + al * jac + keyword + header + phrase
    if prefer_tables and has_table is not None:
        out = out + F.when(has_table, p["table_bonus"]).otherwise(0.0)
    if prefer_shorter:
        out = out + F.when((tokens > 0) & (tokens < p["short_below"]), p["short_bonus"]).otherwise(0.0)
    return out - F.when((tokens > 0) & (tokens < p["stub_below"]), p["stub_penalty"]).otherwise(0.0)


def preference_score(score: Column, has_table: Column, tokens: Column, prefer_tables: bool = False,
                     prefer_shorter: bool = False) -> Column:
    out = score
    if prefer_tables:
        out = out + F.when(has_table, 0.03).otherwise(0.0)
    if prefer_shorter:
        out = out + F.when((tokens > 0) & (tokens < 250), 0.02).otherwise(0.0)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cross_blend(base: Column, logit: Column, weight: float = vocab.CROSS_SCORER["weight"]) -> Column:
    return (1 - weight) * base + weight * sigmoid(logit)


def source_authority(source_type: Column) -> Column:
    s = F.lower(F.trim(T.text_or_empty(source_type)))
    out = F
    for k, v in vocab.SOURCE_AUTHORITY.items():
        out = out.when(s == k, F.lit(v))
    return out.when(s.startswith("pdf"), 0.90).otherwise(vocab.SOURCE_AUTHORITY["general"])


def confidence_band(top_score: Column, gap: Column, role: Column, query: Column, header_match: Column) -> Column:
    """Ordered rules: low below medium; header matches and roles decide between high and medium."""
    c = vocab.CONFIDENCE
    aux = F.lower(role).isin("index_noise", "frontmatter") & ~Q.is_metadata_fact(query)
    thin = Q.is_broad_request(query) & (gap < max(c["ambiguous_gap"], 0.06))
    return (F.when(top_score.isNull() | (top_score < c["medium"]), "low")
            .when(top_score < c["high"], "medium")
            .when(aux, "medium")
            .when(header_match, "high")
            .when(thin, "medium").otherwise("high"))


def header_match(query: Column, title: Column, path: Column, least: int = 1) -> Column:
    """Whether the header of the top row holds at least ``least`` of the query's terms."""
    header = T.search_tokens(F.lower(F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(path))))
    return F.size(F.array_intersect(T.search_tokens(F.lower(query)), header)) >= max(1, least)


def low_confidence(top_score: Column, gap: Column) -> Column:
    return (gap < 0.03) | (top_score < 0.55)

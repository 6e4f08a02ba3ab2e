"""Scalar text functions over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import views as V
from vellum.catalog.registry import query, table
from vellum.functions import cleaning as C, text as T, vocab

TOK = V.tokens_sql


@query("token_counts", "FN-1 FN-2 FN-3 FN-5 FN-6 FN-13 FN-17", f"""
SELECT doc_id, len({TOK('text')})::BIGINT AS search_tokens, len(regexp_extract_all(text,'[A-Za-z0-9_\\-\\.]+'))::BIGINT AS word_tokens,
 least(120, len(regexp_extract_all(lower(text),'[A-Za-z0-9_\\-\\.]+')))::BIGINT AS near_dup_tokens,
 len(list_distinct(regexp_extract_all(lower(text),'[a-z0-9]+')))::BIGINT AS extraction_tokens,
 {V.word_count_sql('text')}::BIGINT AS words, ({V.estimate_sql('text')})::BIGINT AS estimate,
 ({V.word_count_sql('text')} < 4 OR len(regexp_extract_all(text,'[a-zA-Z]{{3,}}')) < 3) AS low_value FROM documents""")
def _(spark, sf):
    t = F.col("text")
    big = lambda c, n: c.cast("bigint").alias(n)
    return table(spark, sf, "documents").select(
        "doc_id", big(F.size(T.search_tokens(t)), "search_tokens"), big(F.size(T.word_tokens(t)), "word_tokens"),
        big(F.size(T.near_duplicate_tokens(t)), "near_dup_tokens"),
        big(F.size(F.array_distinct(T.extraction_tokens(t))), "extraction_tokens"),
        big(T.word_count(t), "words"), big(T.estimate_tokens(t), "estimate"), T.low_value(t).alias("low_value"))


@query("labelled_text_similarity", "FN-4 FN-5 FN-6", """
WITH p AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
 s AS (SELECT doc_id, list_distinct(regexp_extract_all(x,'[A-Za-z][A-Za-z0-9_\\-\\.]+')) AS a1, list_distinct(regexp_extract_all(y,'[A-Za-z][A-Za-z0-9_\\-\\.]+')) AS b1,
  list_distinct(regexp_extract_all(lower(x),'[a-z0-9]+')) AS a2, list_distinct(regexp_extract_all(lower(y),'[a-z0-9]+')) AS b2 FROM p)
SELECT doc_id, round(CASE WHEN len(a1)+len(b1)=0 THEN 1.0 ELSE len(list_intersect(a1,b1))::DOUBLE/(len(a1)+len(b1)-len(list_intersect(a1,b1))) END,6) AS search_jaccard,
 round(CASE WHEN len(a2)+len(b2)=0 THEN 1.0 ELSE len(list_intersect(a2,b2))::DOUBLE/(len(a2)+len(b2)-len(list_intersect(a2,b2))) END,6) AS extraction_jaccard FROM s""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y"))
    j = d.join(nxt, "doc_id")
    return j.select("doc_id",
                    F.round(T.jaccard(T.search_tokens(F.col("text")), T.search_tokens(F.col("y"))), 6).alias("search_jaccard"),
                    F.round(T.jaccard(T.extraction_tokens(F.col("text")), T.extraction_tokens(F.col("y"))), 6)
                    .alias("extraction_jaccard"))


@query("slugs", "FN-7", """
WITH t AS (SELECT p_partkey, p_name||' & I/O - '||p_brand AS name FROM part)
SELECT p_partkey, CASE WHEN p='' THEN 'branch' ELSE p END AS path_slug, anchor_slug FROM (SELECT p_partkey,
 regexp_replace(regexp_replace(regexp_replace(lower(name),'[^\\w\\s-]','','g'),'[\\s_-]+','_','g'),'^_+|_+$','','g') AS p,
 regexp_replace(regexp_replace(lower(name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') AS anchor_slug FROM t)""")
def _(spark, sf):
    n = F.concat("p_name", F.lit(" & I/O - "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", T.path_slug(n).alias("path_slug"),
                                           T.anchor_slug(n).alias("anchor_slug"))


@query("term_variants", "FN-25", f"""
WITH t AS (SELECT DISTINCT unnest({TOK('lower(text)')}) AS term FROM documents)
SELECT term, array_to_string(list_filter([term,
 CASE WHEN term LIKE '%ies' AND length(term)>4 THEN left(term,length(term)-3)||'y' END,
 CASE WHEN term LIKE '%s' AND length(term)>4 THEN left(term,length(term)-1) END,
 CASE WHEN term LIKE '%ing' AND length(term)>5 THEN left(term,length(term)-3) END,
 CASE WHEN term LIKE '%ed' AND length(term)>4 THEN left(term,length(term)-2) END], lambda v: v IS NOT NULL),'|') AS variants FROM t""")
def _(spark, sf):
    t = table(spark, sf, "documents").select(
        F.explode(F.array_distinct(T.search_tokens(F.lower("text")))).alias("term")).distinct()
    return t.select("term", F.array_join(T.term_variants(F.col("term")), "|").alias("variants"))


@query("content_hashes", "FN-49 AG-7", """
SELECT doc_id, sha256(text) AS file_hash, md5(lower(text)) AS fingerprint, sha256(lang||':'||source) AS source_id FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("file_hash"), F.md5(F.lower("text")).alias("fingerprint"),
        F.sha2(F.concat_ws(":", "lang", "source"), 256).alias("source_id"))


@query("corpus_fingerprint", "AG-7", """
SELECT count(*)::BIGINT AS n, max(doc_id)::BIGINT AS last_id, md5('corpus:'||count(*)::VARCHAR||':'||max(doc_id)::VARCHAR) AS fingerprint FROM documents""")
def _(spark, sf):
    from vellum.operators.lexical import corpus_fingerprint
    return corpus_fingerprint(table(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id"), "corpus")


NOISY_SQL = """WITH n AS (SELECT doc_id, replace(replace(replace(replace(replace(text, ', ', '-'||chr(10)), '. ', chr(10)||chr(10)||chr(10)||chr(10)||'• '),
 '###', '  ~~'||chr(9)||' '), '$$$', chr(13)||chr(10)||'<!-- -->'||chr(10)), '&&&', chr(7)||'��') AS text FROM documents)"""


def noisy(spark, sf):
    t = T.replace_literals(F.col("text"), [
        (", ", "-\n"), (". ", "\n\n\n\n• "), ("###", "  ~~\t "), ("$$$", "\r\n<!-- -->\n"), ("&&&", "\x07��")])
    return table(spark, sf, "documents").select("doc_id", t.alias("text"))


S = V.SPACE_SQL
CLEAN_SQL = NOISY_SQL + f""", a AS (SELECT doc_id, replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)) AS t FROM n),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t,'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]','','g'),
  '([\\pL\\pN_)\\]])[\\x{{FFFD}}.·•]{{6,}}\\s*([0-9]{{1,4}})(\\n?)$', '\\1 ... \\2\\3'), '\\x{{FFFD}}{{2,}}',' ','g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t,'([A-Za-z])[-\\x{{AD}}]{S}*\\n{S}*([a-z])','\\1\\2','g'),
  '(?m)^{S}*[•◦▪►▶‣●○�]{S}+','- ','g') AS t FROM b),
d AS (SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(t,'\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
  lambda l: CASE WHEN starts_with(l,'```') THEN l ELSE regexp_replace(regexp_replace(l,'[ \\t]{{2,}}',' ','g'),'{S}+$','') END), chr(10)) AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t,'(?m)^<!--\\s*-->\\s*$\\n?','','g'),'\\n{{3,}}',chr(10)||chr(10),'g') AS t FROM d)
SELECT doc_id, {V.strip_sql('t')}||chr(10) AS cleaned FROM e"""


@query("clean_markdown", "FN-14", CLEAN_SQL)
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", C.clean_markdown(F.col("text")).alias("cleaned"))


def _greek_sql(expr: str) -> str:
    for k, v in vocab.GREEK.items():
        expr = f"replace({expr},'{k}','{v}')"
    return expr


REPAIR_IN = [(", ", " [1 , 2] → f ( x ) "), (". ", " 3 , 000 and 0 . 5 α−β \" "), ("###", " ⌈λ⌉ Q ( a )")]


def _repair_input_sql() -> str:
    e = "text"
    for a, b in REPAIR_IN:
        e = f"replace({e},'{a}','{b}')"
    return e


@query("repair_extraction_noise", "FN-15", f"""
WITH a AS (SELECT doc_id, {_repair_input_sql()} AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t,'(\\d)\\s*,\\s*(\\d)','\\1,\\2','g'),'(\\d)\\s+\\.\\s+(\\d)','\\1.\\2','g'),
 '\\[(\\s*\\d[\\d\\s,.]*)\\]','(\\1)','g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t,'[⇢←→⟵⟶↑↓⟸⟹⇐⇒➤➜]','->','g'),'[−–—]','-','g'),'[⇤⇥⟤⟥⌈⌉⌊⌋⟦⟧〈〉⟨⟩]','','g') AS t FROM b),
d AS (SELECT doc_id, {_greek_sql('t')} AS t FROM c)
SELECT doc_id, regexp_replace(regexp_replace(t,'([A-Za-z_][A-Za-z0-9_]*)\\s+\\(\\s*([^)]{{0,30}}?)\\s*\\)','\\1(\\2)','g'),
 '([\\s,\\-+*/=<>])"([\\s(])','\\1epsilon\\2','g') AS repaired FROM d""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", C.repair_extraction_noise(T.replace_literals(F.col("text"), REPAIR_IN)).alias("repaired"))


PIPES = [(", ", " | | | | | --- | --- | "), (". ", "\n| --- | :--: |\n|||||||\n"), (" the ", "||||")]


def _pipes_sql() -> str:
    e = "text"
    for a, b in PIPES:
        e = f"replace({e},'{a}','{b}')".replace("\n", "'||chr(10)||'")
    return e


LB = "'\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'"


@query("pipe_noise", "FN-35", f"""
WITH a AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN text ELSE {_pipes_sql()} END AS t FROM documents),
b AS (SELECT doc_id, t, list_transform(regexp_split_to_array(t,{LB}), lambda l: {V.strip_sql('l')}) AS ls,
  list_filter(list_transform(regexp_split_to_array(t,{LB}), lambda l: regexp_replace(l,'\\|{{3,}}',' ','g')),
   lambda l: NOT (contains({V.strip_sql('l')},'|') AND regexp_matches({V.strip_sql('l')},'^[\\s|\\-:+]+$'))) AS kept FROM a),
c AS (SELECT doc_id, t, ls, array_to_string(list_transform(kept, lambda l: {V.strip_sql("regexp_replace(l,'[ \\t]+',' ','g')")}),chr(10)) AS k FROM b)
SELECT doc_id, (regexp_matches(t,'\\|{{3,}}') OR (regexp_matches(t,'\\|\\s*[-:]{{3,}}\\s*\\|') AND regexp_matches(t,'( *\\| *){{4,}}'))
  OR len(list_filter(ls, lambda s: length(s)-length(replace(s,'|','')) >= 6 AND (length(s)-length(replace(s,'|','')))::DOUBLE/greatest(1,length(s)) >= 0.4)) >= 2) AS noisy,
 {V.strip_sql("regexp_replace(regexp_replace(regexp_replace(k,'" + "\\|\\s*[-:]{3,}\\s*\\|" + "',' ','g'),'( *\\| *){4,}',' ','g'),'\\n{3,}',chr(10)||chr(10),'g')")} AS cleaned FROM c""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, F.col("text")).otherwise(
        T.replace_literals(F.col("text"), PIPES)).alias("text"))
    return d.select("doc_id", C.is_pipe_noise(F.col("text")).alias("noisy"),
                    C.strip_pipe_noise(F.col("text")).alias("cleaned"))


@query("contents_role_by_leaders", "FN-36", """
WITH a AS (SELECT doc_id, replace(text, '. ', ' . . . . . . 12 ') AS t FROM documents)
SELECT doc_id, ((length(t)-length(replace(t,'. . . . . .','')))//11)::BIGINT AS leaders,
 CASE WHEN (length(t)-length(replace(t,'. . . . . .','')))//11 >= 4 THEN 'toc' ELSE 'body' END AS structural_role FROM a""")
def _(spark, sf):
    t = F.replace(F.col("text"), F.lit(". "), F.lit(" . . . . . . 12 "))
    d = table(spark, sf, "documents").select("doc_id", t.alias("text"), F.lit("body").alias("role"))
    return d.select("doc_id", C.dotted_leader_count(F.col("text")).cast("bigint").alias("leaders"),
                    C.toc_role(F.col("role"), F.col("text")).alias("structural_role"))


PAGE_IN = [(". ", " ....... 12\n"), (", ", " name: ____ date: signature address "), ("The ", "Appendix B: ")]


def _page_sql() -> str:
    e = "text"
    for a, b in PAGE_IN:
        e = f"replace({e},'{a}','{b}')".replace("\n", "'||chr(10)||'")
    return e


_FIELDS_SQL = "+".join(f"contains(low,'{f}')::INT" for f in C.FORM_FIELDS)


@query("page_kinds", "FN-37", f"""
WITH a AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN text ELSE {_page_sql()} END AS t FROM documents),
b AS (SELECT doc_id, array_to_string(regexp_extract_all(t,'{V.NON_SPACE_SQL}+'),' ') AS flat,
 list_filter(list_transform(regexp_split_to_array(t,{LB}), lambda l: {V.strip_sql('l')}), lambda l: length(l)>0) AS rws FROM a),
c AS (SELECT *, lower(flat) AS low, len(rws) AS n, len(list_filter(rws, lambda l: regexp_matches(l,'(?:\\.{{3,}}|_{{3,}}|[-·•]{{3,}})\\s*\\d{{1,4}}\\s*$'))) AS leaders,
 len(list_filter(rws, lambda l: regexp_matches(l,'^\\s*\\d+(?:\\.\\d+){{0,3}}\\s+\\S.*\\d{{1,4}}\\s*$'))) AS numbered,
 len(list_filter(rws, lambda l: length(l)<=120)) AS short_n, array_to_string(rws,' ') AS joined FROM b),
d AS (SELECT *, length(flat)>0 AND (contains(low,'table of contents') OR starts_with(low,'contents ') OR (n>=5 AND (leaders>=3 OR (numbered>=4 AND short_n>=greatest(4,n//2))))) AS toc,
 len(regexp_extract_all(flat,'_{{3,}}|\\.{{4,}}|□|☐|☑')) AS blanks, {_FIELDS_SQL} AS fields, length(flat)-length(replace(flat,':','')) AS colons FROM c)
SELECT doc_id, toc AS contents_page, length(flat)>0 AND NOT toc AND NOT (length(flat)>1200 AND blanks<2)
 AND (blanks>=3 OR (fields>=4 AND colons>=5 AND length(flat)<=900) OR (fields>=3 AND colons>=6 AND length(flat)<=650)) AS form_page,
 n>0 AND n<=4 AND length(joined)<=180 AND NOT contains(lower(joined),'table of contents') AND
 regexp_matches(joined,'(?i)^\\s*(?:appendix|exhibit|attachment|schedule)\\s+[a-z0-9]+(?:\\s*[:\\-]\\s*|\\s+).+') AS appendix_page FROM d""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("text")).otherwise(
        T.replace_literals(F.col("text"), PAGE_IN)).alias("text"))
    t = F.col("text")
    return d.select("doc_id", C.is_contents_page(t).alias("contents_page"), C.is_form_page(t).alias("form_page"),
                    C.is_appendix_divider(t).alias("appendix_page"))


@query("math_notation", "FN-55", "SELECT doc_id, (" + " OR ".join(
    f"regexp_matches(text,'{p}')" for p in vocab.MATH_PATTERNS) + ") AS has_math FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.has_math_notation(F.col("text")).alias("has_math"))


@query("tolerant_json", "FN-53", """
SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE json_extract_string(props,'$.k')::BIGINT END AS k FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props"))
    parsed = F.coalesce(F.from_json(raw, "k bigint"), F.from_json(F.lit("{}"), "k bigint"))
    return e.select("event_id", parsed["k"].alias("k"))

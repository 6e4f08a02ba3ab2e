"""Context packs, coverage, grounding, citations and extractive answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import retrieval as Rt, views as V
from vellum.catalog.registry import query, table
from vellum.functions import citations as Ci, scoring as S, vocab
from vellum.operators import context as Cx, grounding as G

TOK = V.tokens_sql
ANS = "'In 1987 and 2021s Onenth Grand said: '||text||' It rose 42 % [chunk_9] [see note]. Also c123456789 NASA and ZZZ.'||chr(10)||'Citations: [c000001]'"
ASK = "'what is '||array_to_string(regexp_extract_all(text,'[A-Za-z]+')[1:(item_id % 7 + 1)],' ')"
# RE2 word boundaries are ASCII; Latin letters become word characters before boundary tests.
LETTERS = "[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{24F}]"
HITS_SQL = Rt.BASE + Rt.BM25_SQL + f""", hits AS (SELECT query_id, rank::BIGINT AS rank, bm25 AS score, c.* FROM bmr JOIN corpus c USING (chunk_id) WHERE rank <= 8),
 ask AS (SELECT item_id AS query_id, {ASK} AS query FROM benchmark), ans AS (SELECT item_id AS query_id, {ANS} AS answer FROM benchmark)"""


def hits(spark, sf):
    top = Rt.bm25_ranked(spark, sf, 8).withColumnRenamed("bm25", "score")
    return top.join(V.corpus(spark, sf), "chunk_id")


def asks(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    n = (F.col("item_id") % 7 + 1).cast("int")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(
        F.lit("what is "), F.array_join(F.slice(words, 1, n), " ")).alias("query"))


def answers(spark, sf):
    a = F.concat(F.lit("In 1987 and 2021s Onenth Grand said: "), "text", F.lit(
        " It rose 42 % [chunk_9] [see note]. Also c123456789 NASA and ZZZ.\nCitations: [c000001]"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), a.alias("answer"))


# --- context packs ----------------------------------------------------------------
AUTH_SQL = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.SOURCE_AUTHORITY.items()) + " ELSE 0.5 END::DOUBLE"
PACKSRC = Rt.HYBRID + """, ph AS (SELECT query_id, chunk_id, doc_id, score, CASE source_type WHEN 'en' THEN 'pdf_book' WHEN 'de' THEN 'pdf_x' WHEN 'fr' THEN 'internet' ELSE 'other' END AS source_type,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM rr)"""
RANK_SQL = PACKSRC + f""", au AS (SELECT *, round(score + 0.2::DOUBLE*(CASE WHEN source_type IN {V.in_sql(vocab.SOURCE_AUTHORITY)} THEN {AUTH_SQL} WHEN source_type LIKE 'pdf%' THEN 0.90 ELSE 0.50 END)::DOUBLE + 0.02::DOUBLE - (position-1)*1e-6::DOUBLE,9) AS combined FROM ph),
 ar AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, chunk_id)::BIGINT AS authority_rank FROM au)"""


def pack_hits(spark, sf):
    st = F.col("source_type")
    r = Rt.reranked(spark, sf)
    p = r.withColumn("source_type", F.when(st == "en", "pdf_book").when(st == "de", "pdf_x").when(st == "fr", "internet").otherwise("other"))
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return p.select("query_id", "chunk_id", "doc_id", "score", "source_type", "text",
                    F.row_number().over(w).alias("position"))


@query("authority_ranking", "RK-22", RANK_SQL + " SELECT query_id, chunk_id, round(combined,6) AS combined, authority_rank FROM ar")
def _(spark, sf):
    return Cx.rank_with_authority(pack_hits(spark, sf), True).select(
        "query_id", "chunk_id", F.round("combined", 6).alias("combined"), "authority_rank")


@query("diversified_selection", "RK-23", RANK_SQL + """, one AS (SELECT * REPLACE (CASE WHEN authority_rank <= 2 THEN 'same' ELSE doc_id END AS doc_id) FROM ar),
 s AS (SELECT query_id, count(DISTINCT doc_id) AS docs, max(doc_id) AS d, arg_max(score,authority_rank) AS tail FROM one WHERE authority_rank<=2 GROUP BY 1),
 alt AS (SELECT o.query_id, min(o.authority_rank) AS alt FROM one o JOIN s USING (query_id) WHERE o.authority_rank>2 AND s.docs=1 AND o.doc_id<>s.d AND s.tail-o.score <= 0.06+1e-12 GROUP BY 1)
SELECT o.query_id, o.chunk_id, alt IS NOT NULL AS diversified FROM one o LEFT JOIN alt USING (query_id) WHERE CASE WHEN alt IS NULL THEN authority_rank<=2 ELSE authority_rank<2 OR authority_rank=alt END""")
def _(spark, sf):
    r = Cx.rank_with_authority(pack_hits(spark, sf), True)
    one = r.withColumn("doc_id", F.when(F.col("authority_rank") <= 2, "same").otherwise(F.col("doc_id")))
    return Cx.diversify(one, 2, F.lit("summary")).select("query_id", "chunk_id", "diversified")


@query("boundary_order", "WN-9", RANK_SQL + """ SELECT query_id, chunk_id, (CASE WHEN (authority_rank-1)%2=0 THEN (authority_rank-1)//2 ELSE 6-(authority_rank-2)//2 END)::BIGINT AS presented FROM ar WHERE authority_rank<=7""")
def _(spark, sf):
    r = Cx.rank_with_authority(pack_hits(spark, sf), True).where("authority_rank <= 7")
    return Cx.boundary_order(r, "authority_rank").select("query_id", "chunk_id", "presented")


@query("context_pack", "RK-20 RK-21 RK-23")
def _(spark, sf):
    return Cx.context_pack(pack_hits(spark, sf), 6, F.lit("summary"), web_first=True).select(
        "query_id", "chunk_id", "selected_rank", "presented", F.round("combined", 6).alias("combined"))


@query("hits_without_repeats", "RK-21 SE-2", PACKSRC + """, u AS (SELECT query_id, chunk_id % 50 AS chunk_id, doc_id, position FROM ph)
SELECT query_id, chunk_id, arg_min(doc_id, position) AS doc_id, min(position)::BIGINT AS position FROM u GROUP BY 1,2""")
def _(spark, sf):
    h = pack_hits(spark, sf).select("query_id", (F.col("chunk_id") % 50).alias("chunk_id"), "doc_id", "position")
    return Cx.drop_repeated(h.withColumn("text", F.lit(""))).select(
        "query_id", "chunk_id", "doc_id", F.col("position").cast("bigint").alias("position"))


@query("selected_citations", "RK-30", PACKSRC + """, c AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ph)
SELECT query_id, chunk_id, position::BIGINT AS cite_rank FROM c WHERE position <= 3 AND (round(top-score,9) <= 0.06 OR position <= 2)""")
def _(spark, sf):
    return Cx.select_citations(pack_hits(spark, sf)).select("query_id", "chunk_id", "cite_rank")


@query("api_citations", "RK-36", HITS_SQL + f""", h AS (SELECT *, rank IN (2,5) AS cited FROM hits), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, round(score,6) DESC, chunk_id)::BIGINT AS position FROM h)
SELECT query_id, chunk_id, cited, position, {V.strip_sql('left(text,300)')}||CASE WHEN length(text)>300 THEN '…' ELSE '' END AS snippet FROM o WHERE position <= 8""")
def _(spark, sf):
    h = hits(spark, sf)
    return Cx.api_citations(h, h.where("rank IN (2, 5)")).select("query_id", "chunk_id", "cited", "position", "snippet")


# --- coverage and grounding -------------------------------------------------------------
STOPS = sorted(set(vocab.ANSWER_STOPWORDS) | set(vocab.COVERAGE_STOPWORDS))


def stop_terms_sql(e: str) -> str:
    return f"list_filter({TOK(f'lower({e})')}, lambda t: length(t)>2 AND NOT list_contains({V.list_sql(STOPS)},t))"


def present_sql(t: str, low: str) -> str:
    n = f"length({t})"
    return (f"(contains({low},{t}) OR ({t} LIKE '%ies' AND {n}>4 AND contains({low},left({t},{n}-3)||'y')) OR ({t} LIKE '%s' AND {n}>4 AND contains({low},left({t},{n}-1))) "
            f"OR ({t} LIKE '%ing' AND {n}>5 AND contains({low},left({t},{n}-3))) OR ({t} LIKE '%ed' AND {n}>4 AND contains({low},left({t},{n}-2))))")


COV_SQL = HITS_SQL + f""", qt2 AS (SELECT query_id, {stop_terms_sql('query')} AS terms FROM ask),
 tx AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms,1) AS pos FROM qt2), h3 AS (SELECT query_id, rank, lower(text) AS low, length(text) AS n FROM hits WHERE rank<=3),
 fl AS (SELECT t.query_id, t.pos, h.rank, {present_sql('t.term', 'h.low')} AS hit FROM tx t JOIN h3 h USING (query_id)),
 pb AS (SELECT query_id, max(c) AS best FROM (SELECT query_id, rank, count(*) FILTER (WHERE hit) AS c FROM fl GROUP BY 1,2) GROUP BY 1),
 un AS (SELECT query_id, pos, bool_or(hit) AS hit FROM fl GROUP BY 1,2), uc AS (SELECT query_id, count(*) FILTER (WHERE hit) AS found FROM un GROUP BY 1),
 tl AS (SELECT query_id, max(n) FILTER (WHERE rank=1) AS top_len FROM h3 GROUP BY 1),
 cov AS (SELECT q.query_id, round(CASE WHEN len(terms)<=1 THEN 1.0 WHEN COALESCE(top_len,0)<40 THEN 1.0 WHEN len(terms)=2 THEN COALESCE((SELECT hit FROM un WHERE un.query_id=q.query_id AND pos=CASE WHEN length(terms[1])>=length(terms[2]) THEN 1 ELSE 2 END),FALSE)::INT
   ELSE greatest(COALESCE(best,0),COALESCE(found,0))::DOUBLE/len(terms) END::DOUBLE,6) AS coverage FROM qt2 q LEFT JOIN pb USING (query_id) LEFT JOIN uc USING (query_id) LEFT JOIN tl USING (query_id))"""


@query("lexical_coverage", "RK-31 FN-25", COV_SQL + " SELECT query_id, coverage FROM cov")
def _(spark, sf):
    return G.lexical_coverage(asks(spark, sf), hits(spark, sf))


BODY_SQL = "regexp_replace(string_split_regex(trim(answer),'(?i)\\n\\s*Citations\\s*:\\s*')[1],'\\[[^\\[\\]]{1,20}\\]','','g')"


def sentences_sql(e: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({V.strip_sql(e)},'([.!?]){V.SPACE_SQL}+','\\1'||chr(1),'g'),chr(1)), lambda s: {V.strip_sql('s')}), lambda s: length(s)>0)"


@query("sentence_faithfulness", "RK-33", HITS_SQL + f""", b AS (SELECT query_id, {sentences_sql(BODY_SQL)} AS ss FROM ans),
 s AS (SELECT query_id, unnest(ss) AS sentence, generate_subscripts(ss,1)-1 AS sentence_no FROM b), t AS (SELECT query_id, sentence_no, {stop_terms_sql('sentence')} AS terms FROM s),
 u AS (SELECT query_id, sentence_no, unnest(terms) AS term, generate_subscripts(terms,1) AS pos FROM t WHERE len(terms)>=3),
 f AS (SELECT u.query_id, sentence_no, pos, bool_or({present_sql('term', 'lower(text)')}) AS hit FROM u JOIN hits USING (query_id) GROUP BY 1,2,3)
SELECT query_id, sentence_no::BIGINT AS sentence_no, round_even(count(*) FILTER (WHERE hit)::DOUBLE/count(*),3) AS coverage, count(*) FILTER (WHERE hit)::DOUBLE/count(*) < 0.35 AS flagged FROM f GROUP BY 1,2""")
def _(spark, sf):
    return G.sentence_faithfulness(answers(spark, sf), hits(spark, sf)).withColumn(
        "sentence_no", F.col("sentence_no").cast("bigint"))


@query("unsupported_entities", "RK-32", HITS_SQL + f""", e AS (SELECT a.query_id, list_distinct(regexp_extract_all(regexp_replace(trim(string_split_regex(trim(answer),'(?i)\\n\\s*Citations\\s*:\\s*')[1]),'{LETTERS}','_','g'),'\\b(?:[A-Z][a-z]{{2,}}|[A-Z]{{2,10}})\\b')) AS ents, {TOK('lower(query)')} AS asked FROM ans a JOIN ask USING (query_id)),
 u AS (SELECT query_id, len(ents) AS total, asked, unnest(ents) AS entity FROM e), m AS (SELECT u.query_id, total, entity FROM u JOIN hits USING (query_id) WHERE lower(entity) NOT IN {V.in_sql(vocab.ENTITY_IGNORE)} AND NOT list_contains(asked,lower(entity)) GROUP BY 1,2,3 HAVING NOT bool_or(contains(lower(text),lower(entity))))
SELECT query_id, entity FROM m WHERE query_id IN (SELECT query_id FROM m GROUP BY 1 HAVING count(*)>=3 AND count(*)::DOUBLE/max(total)>=0.4)""")
def _(spark, sf):
    return G.unsupported_entities(answers(spark, sf), asks(spark, sf), hits(spark, sf))


@query("answer_policy", "RK-34", COV_SQL + """, g AS (SELECT a.query_id, query, coverage, max(score) FILTER (WHERE rank=1)/20 AS top_score FROM ask a JOIN cov USING (query_id) JOIN hits USING (query_id) GROUP BY 1,2,3),
 p AS (SELECT *, CASE WHEN top_score<0.55 THEN 'low' WHEN top_score<0.70 THEN 'medium' ELSE 'high' END AS band, CASE query_id%4 WHEN 0 THEN 'formula_lookup' WHEN 1 THEN 'section_lookup' ELSE 'fact_lookup' END AS intent FROM g)
SELECT query_id, CASE WHEN query_id%11=0 THEN 'internet_no_evidence' WHEN top_score<0.38 AND intent<>'section_lookup' THEN 'low_score' WHEN intent='fact_lookup' AND band<>'high' AND coverage<=0 THEN 'zero_lexical_coverage'
 WHEN intent='fact_lookup' AND band<>'high' AND coverage<0.55 THEN 'low_lexical_coverage' WHEN intent='formula_lookup' AND query_id%3<>0 THEN 'formula_not_found' ELSE 'generate' END AS policy FROM p""")
def _(spark, sf):
    h, a = hits(spark, sf), asks(spark, sf)
    top = h.where("rank = 1").select("query_id", (F.col("score") / 20).alias("top_score"))
    j = G.lexical_coverage(a, h).join(top, "query_id").join(a, "query_id")
    q = F.col("query_id")
    band = S.confidence_band(F.col("top_score"), F.lit(1.0), F.lit("body"), F.lit("x"), F.lit(False))
    intent = F.when(q % 4 == 0, "formula_lookup").when(q % 4 == 1, "section_lookup").otherwise("fact_lookup")
    none = F.lit(False)
    return j.select("query_id", G.answer_policy(band, F.col("top_score"), F.col("coverage"), intent, none,
                                                q % 3 == 0, none, q % 11 == 0, F.lit(0)).alias("policy"))


# --- citations -----------------------------------------------------------------------------
@query("short_citations", "FN-26", V.LIBRARY_SQL + """, i AS (SELECT CASE WHEN token_count_est % 3 = 0 THEN doc_id||'-c'||lpad((page_start)::VARCHAR,6,'0') WHEN token_count_est % 3 = 1 THEN 'x c'||page_start::VARCHAR ELSE chunk_id END AS id FROM chunks WHERE page_start IS NOT NULL)
SELECT id, CASE WHEN regexp_extract(id,'-c(\\d{6})$',1)<>'' THEN 'c'||regexp_extract(id,'-c(\\d{6})$',1) WHEN regexp_extract(id,'(?i)\\bc(\\d{1,6})\\b',1)<>'' THEN 'c'||lpad(regexp_extract(id,'(?i)\\bc(\\d{1,6})\\b',1),6,'0') ELSE right(id,12) END AS tag, count(*)::BIGINT AS n FROM i GROUP BY 1,2""")
def _(spark, sf):
    c = V.library_chunks(spark, sf).where("page_start IS NOT NULL")
    k, p = F.col("token_count_est") % 3, F.col("page_start").cast("string")
    ids = c.select(F.when(k == 0, F.concat("doc_id", F.lit("-c"), F.lpad(p, 6, "0"))).when(
        k == 1, F.concat(F.lit("x c"), p)).otherwise(F.col("chunk_id")).alias("id"))
    return ids.groupBy("id", Ci.short_citation(F.col("id")).alias("tag")).agg(F.count("*").alias("n"))


def _noise_sql(e: str) -> str:
    for p in Ci.NOISE:
        e = f"regexp_replace({e},'{p}','','g')"
    return e


@query("normalized_answers", "FN-27", HITS_SQL + f""", a1 AS (SELECT query_id, regexp_replace({_noise_sql('answer')},'\\[\\s*\\]','','g') AS t FROM ans),
 a2 AS (SELECT query_id, regexp_replace(t,'(?i)\\[(c\\d{{6}})\\]',chr(1)||'\\1'||chr(2),'g') AS t FROM a1), a3 AS (SELECT query_id, replace(replace(regexp_replace(t,'\\[[^\\[\\]'||chr(1)||chr(2)||']{{1,140}}\\]','','g'),chr(1),'['),chr(2),']') AS t FROM a2),
 a4 AS (SELECT query_id, regexp_replace(regexp_replace(regexp_replace(t,'\\s+([,.;:!?])','\\1','g'),'\\s{{2,}}',' ','g'),'\\n{{3,}}',chr(10)||chr(10),'g') AS t FROM a3)
SELECT query_id, {V.strip_sql('t')}||chr(10)||chr(10)||'Citations: [c000007], [c'||lpad(query_id::VARCHAR,6,'0')||']' AS answer, trim(string_split_regex(trim(answer),'(?i)\\n\\s*Citations\\s*:\\s*')[1]) AS body FROM a4 JOIN ans USING (query_id)""")
def _(spark, sf):
    tags = F.array(F.lit("c000007"), F.concat(F.lit("c"), F.lpad(F.col("query_id").cast("string"), 6, "0")))
    return answers(spark, sf).select("query_id", Ci.normalize_answer(F.col("answer"), tags).alias("answer"),
                                     Ci.strip_citation_block(F.col("answer")).alias("body"))


@query("cited_sentences", "FN-28", f"""WITH ss AS (SELECT doc_id, {sentences_sql('text')} AS s FROM documents),
 f AS (SELECT doc_id, list_transform(s, lambda x: {{'t': x, 'm': (len({TOK('lower(x)')})>=5 OR regexp_matches(x,'\\d')) AND NOT regexp_matches(x,'\\[[^\\[\\]]+\\]')}}) AS s FROM ss)
SELECT doc_id, array_to_string(list_transform(s, lambda x: CASE WHEN x.m THEN x.t||' [c000001]' ELSE x.t END),' ') AS answer, len(list_filter(s, lambda x: x.m))::BIGINT AS added FROM f""")
def _(spark, sf):
    body, added = Ci.cite_sentences(F.col("text"), F.lit("c000001"))
    return table(spark, sf, "documents").select("doc_id", body.alias("answer"), added.cast("bigint").alias("added"))


@query("fact_checks", "FN-50", """WITH f AS (SELECT item_id, regexp_replace(text,'([a-z]) ([a-z])','\\1 4 , 2 % \\2') AS ans, substring(text,5,9)||'|zz|4,2 percent' AS fact FROM benchmark),
 n AS (SELECT item_id, lower(regexp_replace(regexp_replace(ans,'(\\d)\\s*%','\\1 percent','g'),'(\\d)\\s*,\\s*(\\d)','\\1,\\2','g')) AS a, string_split(CASE WHEN item_id%3=0 THEN 'no|none' ELSE fact END,'|') AS alts FROM f)
SELECT item_id, len(list_filter(alts, lambda x: contains(a, lower(x))))>0 AS holds FROM n""")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    ans = F.regexp_replace("text", "([a-z]) ([a-z])", "$1 4 , 2 % $2")
    # The rewrite above touches every match in Java; the fact only needs the first.
    fact = F.when(F.col("item_id") % 3 == 0, "no|none").otherwise(F.concat(F.substring("text", 5, 9), F.lit("|zz|4,2 percent")))
    return b.select("item_id", Ci.has_fact(ans, fact).alias("holds"))


@query("grounding_counters", "FN-51 EV-13", HITS_SQL + f""", src AS (SELECT query_id, lower(string_agg(text, chr(10) ORDER BY rank)) AS src FROM hits WHERE rank<=3 GROUP BY 1),
 p AS (SELECT query_id, answer, src, list_filter(list_transform(string_split(regexp_replace(regexp_replace(answer,'([.!?])\\s+','\\1'||chr(1),'g'),'\\n+',chr(1),'g'),chr(1)), lambda s: {V.strip_sql('s')}), lambda s: length(s)>0) AS parts FROM ans JOIN src USING (query_id)),
 c AS (SELECT query_id, len(list_filter(list_transform(parts, lambda s: list_filter(regexp_extract_all(lower(s),'[A-Za-z]{{3,}}'), lambda t: NOT list_contains({V.list_sql(Ci.GROUNDING_STOPWORDS)},t))), lambda ts: len(ts)>=6 AND len(list_filter(ts, lambda t: contains(src,t)))::DOUBLE/len(ts) < 0.5))::BIGINT AS weak_sentences,
  len(list_filter(regexp_extract_all(answer,'\\b(19\\d{{2}}|20\\d{{2}}|\\d{{4}}s)\\b',1), lambda y: NOT contains(src,lower(y))))::BIGINT AS unsupported_years,
  len(list_filter(list_distinct(regexp_extract_all(regexp_replace(answer,'{LETTERS}','_','g'),'\\b[A-Z][A-Za-z]{{2,}}\\b')), lambda e: lower(e) NOT IN ('citations','chapter','part') AND NOT contains(src,lower(e))))::BIGINT AS unsupported_entities,
  len(regexp_extract_all(answer,'(?i)\\bc[0-9a-f]{{20,}}\\b|\\bc\\d{{7,}}\\b|\\[ch[a-z0-9_-]{{6,}}\\]'))::BIGINT AS malformed_citations FROM p)
SELECT *, query_id%5=0 OR (unsupported_years=0 AND malformed_citations=0 AND weak_sentences<=1) AS passed FROM c""")
def _(spark, sf):
    src = hits(spark, sf).where("rank <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n").alias("source"))
    c = G.grounding_counters(answers(spark, sf), src, Ci.GROUNDING_STOPWORDS)
    return G.grounding_pass(c, F.col("query_id") % 5 == 0)


# --- extractive answers -----------------------------------------------------------------------
KWSTOP = V.list_sql(vocab.ANSWER_STOPWORDS)


def hit_sent_sql(low: int, high: int) -> str:
    return (f"hs0 AS (SELECT query_id, rank, chunk_id, {sentences_sql('array_to_string(regexp_extract_all(text,' + chr(39) + V.NON_SPACE_SQL + '+' + chr(39) + '),' + chr(39) + ' ' + chr(39) + ')')} AS ss FROM hits), "
            f"hs AS (SELECT * FROM (SELECT query_id, rank, chunk_id, unnest(ss) AS sentence, generate_subscripts(ss,1)-1 AS sent_no FROM hs0) WHERE length(sentence) BETWEEN {low} AND {high})")


BEST_SQL = """, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(sentence) ORDER BY score DESC, rank, sent_no) AS r0 FROM sc) WHERE r0=1),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, sent_no)::BIGINT AS position FROM once)
SELECT query_id, chunk_id, sentence, score, position FROM best WHERE position <= 2"""


@query("section_summary_sentences", "RK-35b", HITS_SQL + f""", kw AS (SELECT query_id, list_filter(list_distinct({TOK('lower(query)')}), lambda t: length(t)>2 AND NOT list_contains({KWSTOP},t) AND NOT list_contains({V.list_sql(G.SUMMARY_IGNORE)},t)) AS kw FROM ask),
 {hit_sent_sql(45, 320)}, sc AS (SELECT *, round(len(list_filter(kw, lambda t: {present_sql('t', 'lower(sentence)')})) + CASE WHEN {' OR '.join(f"contains(lower(sentence),'{w}')" for w in G.STRUCTURE_WORDS)} THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN {V.word_count_sql('sentence')}>=12 THEN 0.2 ELSE 0 END::DOUBLE,6) AS score FROM hs JOIN kw USING (query_id))
 , sc2 AS (SELECT * FROM sc WHERE score>0)""" + BEST_SQL.replace("FROM sc)", "FROM sc2)"))
def _(spark, sf):
    return G.section_summary(asks(spark, sf), hits(spark, sf)).select("query_id", "chunk_id", "sentence", "score", "position")


@query("factoid_sentences", "RK-35e", HITS_SQL + f""", k0 AS (SELECT query_id, query, list_filter(list_distinct({TOK('lower(query)')}), lambda t: length(t)>2 AND NOT list_contains({KWSTOP},t)) AS k FROM ask),
 k1 AS (SELECT *, list_filter(k, lambda t: t NOT IN ('meaning','explain','describe','overview','summary','detail','details')) AS s FROM k0),
 kw AS (SELECT query_id, CASE WHEN len(s)>0 THEN s ELSE k END AS kw, regexp_matches(query,'\\d') AS digits FROM k1),
 {hit_sent_sql(30, 320)}, so AS (SELECT *, len(list_filter(kw, lambda t: contains(lower(sentence),t))) AS o FROM hs JOIN kw USING (query_id)),
 sc AS (SELECT *, round((o + CASE WHEN digits AND regexp_matches(sentence,'\\d') THEN 1 ELSE 0 END + CASE WHEN {' OR '.join(f"contains(lower(sentence),'{w}')" for w in G.PUBLICATION_WORDS)} THEN 1 ELSE 0 END)::DOUBLE,6) AS score FROM so WHERE len(kw)=0 OR o>0)""" + BEST_SQL)
def _(spark, sf):
    return G.factoid_sentences(asks(spark, sf), hits(spark, sf)).select("query_id", "chunk_id", "sentence", "score", "position")


@query("fallback_excerpts", "RK-35f", HITS_SQL + f""" SELECT query_id, chunk_id, CASE WHEN length({V.strip_sql('text')})>320 THEN regexp_replace(left({V.strip_sql('text')},320),'{V.SPACE_SQL}+$','')||' ...' ELSE {V.strip_sql('text')} END AS excerpt FROM hits WHERE rank<=3""")
def _(spark, sf):
    return hits(spark, sf).where("rank <= 3").select("query_id", "chunk_id", Ci.excerpt(F.col("text"), 320).alias("excerpt"))



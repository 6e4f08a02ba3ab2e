"""Evidence extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import retrieval as Rt, views as V
from vellum.catalog.registry import query, table
from vellum.functions import embedder, evidence as E, text as T, vocab
from vellum.operators import extraction as X
from vellum.plans import extract

BRANCHES = (
    X.Branch("Safety", ("onenth", "password", "erblees"), "Safety scope", 40, priorities=(("src1", 1.5), ("src2", 0.8))),
    X.Branch("controls", ("bleing", "stonea", "onhethe"), priorities=(("src7", 2.0),)),
    X.Branch("Finance", ("heitver", "keitver", "onenth")),
    X.Branch("Site", ("mentoi", "auxelle", "ciónan")),
    X.Branch("Unused", ("the",), enabled=False),
)
SP = V.SPACE_SQL


def strip_html_sql(e: str) -> str:
    return V.strip_sql(f"regexp_replace(regexp_replace({e},'<[^>]+>','','g'),'{SP}+',' ','g')")


def wrappers_sql(e: str) -> str:
    return V.strip_sql(f"regexp_replace({strip_html_sql(e)},'{E.LEADING_WRAPPERS}','')")


def any_sql(col: str, words) -> str:
    return "(" + " OR ".join("contains(" + col + ",'" + w.replace("'", "''") + "')" for w in words) + ")"


def admin_sql(c: str) -> str:
    h = f"left(lower({c}),280)"
    return (f"({c}='' OR {any_sql(h, ('table of contents', 'revision history'))} OR (contains({h},'appendix') AND length({c})<1200) OR "
            f"({any_sql(h, ('good faith efforts', 'gfe outreach', 'refer to dmi', 'refer to gmi'))} AND length({c})<260) OR regexp_matches(lower({c}),'^(contents|table of contents)\\b'))")


def class_sql(c: str) -> str:
    n = f"length({c})"
    return (f"CASE WHEN {c}='' THEN 'heading_only' WHEN {any_sql(f'lower({c})', vocab.APPENDIX_PHRASES)} AND {n}<180 THEN 'appendix_admin' "
            f"WHEN {any_sql(f'lower({c})', vocab.REFERENCE_PHRASES)} AND {n}<220 THEN 'reference_only' WHEN regexp_matches({c},'^\\d+(?:\\.\\d+){{1,4}}\\s*[A-Za-z\"].{{0,90}}$') THEN 'heading_only' "
            f"WHEN {n}<90 AND (regexp_matches({c},'^\\*{{0,2}}\\d+(?:\\.\\d+){{1,4}}') OR (regexp_matches({c},'^[A-Z0-9][A-Za-z0-9/&\".():\\- ]{{2,80}}$') AND NOT contains({c},'.'))) THEN 'heading_only' ELSE 'substantive' END")


def kind_sql(text: str, filename: str) -> str:
    out = "CASE "
    for kind, any_of, groups in vocab.SOURCE_KIND_RULES:
        conds = [any_sql("hay", any_of)] if any_of else []
        if groups:
            conds.append("(" + " AND ".join(any_sql("hay", g) for g in groups) + ")")
        out += f"WHEN {' OR '.join(conds)} THEN '{kind}' "
    return out + "ELSE 'unknown' END"


def hay_sql(text: str, filename: str) -> str:
    return f"regexp_replace(lower({filename}||chr(10)||{text}),'{SP}+',' ','g')"


# Leading words are swapped for wrappers and stock phrases so that every rule meets the data.
DRESS = (("^The ", "**[ TABLE ] Agenda Page 12 (Refer to DMI 50 form x) "), ("^On ", "4.2.1 Heading "),
         ("^[A-D][a-z]+ ", "Appendix B see form "), ("^E[a-z]+ ", "Meeting minutes attendees: "),
         ("^T[a-z]+ ", "<b>Refer to</b> scoring option "), ("^[F-L][a-z]+ ", "Notary public SCADA city standards "))


def dressed(spark, sf):
    t = F.col("text")
    for p, r in DRESS:
        t = F.regexp_replace(t, p, r)
    return table(spark, sf, "documents").select("doc_id", "source", t.alias("text"))


def _dress_sql() -> str:
    e = "text"
    for p, r in DRESS:
        e = f"regexp_replace({e},'{p}','{r}')"
    return f"dr AS (SELECT doc_id, source, {e} AS text FROM documents)"


@query("evidence_classes", "FN-29 FN-30", f"WITH {_dress_sql()}, c AS (SELECT doc_id, {wrappers_sql('text')} AS clean FROM dr) SELECT doc_id, {class_sql('clean')} AS evidence_class, {admin_sql('clean')} AS administrative, md5(lower(clean)) AS norm FROM c")
def _(spark, sf):
    d = dressed(spark, sf).select("doc_id", E.strip_wrappers(F.col("text")).alias("clean"))
    c = F.col("clean")
    return d.select("doc_id", E.evidence_class(c).alias("evidence_class"), E.is_appendix_or_contents(c).alias("administrative"),
                    F.md5(F.lower(c)).alias("norm"))


LABEL_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SOURCE_KIND_LABELS.items()) + " END"


@query("source_kinds", "FN-31", f"WITH {_dress_sql()}, h AS (SELECT doc_id, {hay_sql('text', 'source')} AS hay FROM dr), k AS (SELECT doc_id, {kind_sql('', '')} AS kind FROM h) SELECT doc_id, kind, {LABEL_SQL} AS label FROM k")
def _(spark, sf):
    k = dressed(spark, sf).select("doc_id", E.source_kind(F.col("text"), F.col("source")).alias("kind"))
    return k.withColumn("label", E.source_kind_label(F.col("kind")))


ARTI = ((r"^([A-Z])([a-z]{1,3}) ", "$1  $2  "), (r"^([A-Z])([a-z]+) ([a-z])", "$1 ( x ):   $2  $3"))


def _once_sql(s: str) -> str:
    lead = f"regexp_extract(left({s},60),'^(.*?\\s{{2,}})',1)"
    return f"CASE WHEN length({lead})>0 AND NOT regexp_matches({lead},'[a-zA-Z]{{5,}}') THEN substring({s},length({lead})+1) ELSE {s} END"


@query("scan_previews", "FN-32", f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text,'^([A-Z])([a-z]{{1,3}}) ','\\1  \\2  '),'^([A-Z])([a-z]+) ([a-z])','\\1 ( x ):   \\2  \\3') AS t FROM documents),
b AS (SELECT doc_id, {V.strip_sql("replace(replace(t,chr(10),' '),chr(13),' ')")} AS l FROM a), c AS (SELECT doc_id, {_once_sql('l')} AS l FROM b), d AS (SELECT doc_id, {_once_sql('l')} AS l FROM c), e AS (SELECT doc_id, {_once_sql('l')} AS l FROM d)
SELECT doc_id, l AS full_line, CASE WHEN length(l) <= 80 THEN l ELSE left(l,80)||'…' END AS short_line FROM e""")
def _(spark, sf):
    t = F.col("text")
    for p, r in ARTI:
        t = F.regexp_replace(t, p, r)
    return table(spark, sf, "documents").select("doc_id", E.preview(t).alias("full_line"), E.preview(t, 80).alias("short_line"))


@query("scan_response_ids", "FN-33", """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN '['||user_id||'], ['||(event_id%7)||'] and ['||user_id||']' WHEN 'view' THEN 'take '||user_id||' then '||(event_id%5)||' page'
 WHEN 'error' THEN ' none ' ELSE '• ['||(event_id%9)||']' END AS resp FROM events),
x AS (SELECT event_id, CASE WHEN upper(trim(resp))='NONE' THEN []::VARCHAR[] WHEN len(regexp_extract_all(resp,'\\[(\\d+)\\]',1))>0 THEN regexp_extract_all(resp,'\\[(\\d+)\\]',1) ELSE regexp_extract_all(resp,'\\b(\\d+)\\b',1) END AS ids FROM r),
u AS (SELECT event_id, unnest(ids)::BIGINT AS id, generate_subscripts(ids,1) AS pos FROM x), f AS (SELECT event_id, id, min(pos) AS pos FROM u GROUP BY 1,2)
SELECT event_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids FROM f GROUP BY 1""")
def _(spark, sf):
    et, s = F.col("event_type"), lambda c: c.cast("string")
    u, e = s(F.col("user_id")), F.col("event_id")
    resp = (F.when(et == "click", F.concat(F.lit("["), u, F.lit("], ["), s(e % 7), F.lit("] and ["), u, F.lit("]")))
            .when(et == "view", F.concat(F.lit("take "), u, F.lit(" then "), s(e % 5), F.lit(" page")))
            .when(et == "error", F.lit(" none ")).otherwise(F.concat(F.lit("• ["), s(e % 9), F.lit("]"))))
    ids = E.parse_scan_response(resp)
    return table(spark, sf, "events").select("event_id", F.array_join(ids.cast("array<string>"), ",").alias("ids")).where("ids <> ''")


# --- the branch run ---------------------------------------------------------------------------
def chunks(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), (F.col("n_chars") % 60).cast("int").alias("page_start"), "text", "n_chars")


def base_score():
    return F.col("n_chars") % 97 / F.lit(100.0)


def _branch_sql() -> str:
    lanes = []
    for i, b in enumerate(BRANCHES):
        if b.enabled:
            n = " + ".join(f"regexp_matches(text,'{E.keyword_pattern([k])}')::INT" for k in b.keywords)
            w = "CASE " + " ".join(f"WHEN contains(lower(source),'{p}') THEN {v}::DOUBLE" for p, v in b.priorities) + " ELSE 1.0::DOUBLE END" if b.priorities else "1.0::DOUBLE"
            lanes.append(f"SELECT doc_id AS chunk_id, source, n_chars, text, {i} AS branch_ord, '{b.name}' AS branch_name, {n} AS matches, {w} AS priority_weight FROM documents")
    return ("WITH l AS (" + " UNION ALL ".join(lanes) + "), c AS (SELECT *, round(((n_chars % 97)/100.0::DOUBLE + 0.05::DOUBLE*least(matches,5)) * priority_weight,6) AS score, "
            f"{wrappers_sql('text')} AS clean FROM l WHERE matches > 0), a AS (SELECT *, NOT {admin_sql('clean')} AS keep FROM c), "
            "p AS (SELECT * FROM a WHERE keep OR branch_ord NOT IN (SELECT branch_ord FROM a WHERE keep)), "
            "pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch_ord ORDER BY score DESC, chunk_id)::BIGINT AS pool_rank FROM p) WHERE pool_rank <= 500)")


POOL_SQL = _branch_sql()


def pool(spark, sf, cap=X.POOL_CAP):
    return X.branch_pools(chunks(spark, sf), BRANCHES, base_score(), cap)


@query("branch_pools", "EX-2 FN-34 JN-14", POOL_SQL + " SELECT branch_name, chunk_id, score, priority_weight, pool_rank FROM pool")
def _(spark, sf):
    return pool(spark, sf).select("branch_name", "chunk_id", "score", "priority_weight", "pool_rank")


ASKED_BRANCHES = (*BRANCHES, X.Branch("Topics", mode="semantic", topic="onenth thorreou of the stonea and bleing"),
                  X.Branch("Mentions", ("re.re",), regex=True, mode="semantic", priorities=(("src3", 1.25),)))


@query("branch_retrieval", "EX-1 EX-2 RK-3 RK-4 RK-8")
def _(spark, sf):
    """Hashed vectors of the texts themselves, the stored index, and every branch as one query."""
    rows = V.corpus(spark, sf).withColumn("source_name", F.col("doc_id"))
    vectors = rows.select("chunk_id", embedder.hash_embedding(F.col("text"), 128).alias("embedding"))
    found = extract.retrieve_pools(rows, vectors, ASKED_BRANCHES, lambda q: embedder.hash_embedding(q, 128),
                                   index=Rt.term_index(spark, sf))
    return found.select("branch_name", "chunk_id", "matches", "score", "priority_weight", "pool_rank")


@query("scan_batches", "SQ-11 SQ-13 EX-3", POOL_SQL + f""", pv AS (SELECT branch_ord, chunk_id, pool_rank, {V.strip_sql("replace(replace(text,chr(10),' '),chr(13),' ')")} AS l0 FROM pool),
 p1 AS (SELECT branch_ord, chunk_id, pool_rank, {_once_sql('l0')} AS l1 FROM pv), p2 AS (SELECT branch_ord, chunk_id, pool_rank, {_once_sql('l1')} AS l2 FROM p1), p3 AS (SELECT branch_ord, chunk_id, pool_rank, {_once_sql('l2')} AS preview FROM p2),
 g AS (SELECT branch_ord, list({{'u': length(preview)::BIGINT+10, 'b': 1::BIGINT, 'o': []::BIGINT[]}} ORDER BY pool_rank) AS m FROM p3 GROUP BY 1),
 r AS (SELECT branch_ord, list_reduce(m, lambda a, x: {{'u': CASE WHEN a.u+x.u > 10000 THEN x.u ELSE a.u+x.u END, 'b': CASE WHEN a.u+x.u > 10000 THEN a.b+1 ELSE a.b END, 'o': list_append(a.o, a.b)}}) AS z FROM g),
 b AS (SELECT branch_ord, unnest(list_append(z.o, z.b)) AS batch, generate_subscripts(list_append(z.o, z.b),1) AS pool_rank FROM r)
SELECT branch_ord::BIGINT AS branch_ord, chunk_id, pool_rank AS short_id, batch, '['||pool_rank::VARCHAR||'] '||preview AS line FROM p3 JOIN b USING (branch_ord, pool_rank)""")
def _(spark, sf):
    return X.scan_batches(pool(spark, sf)).withColumn("branch_ord", F.col("branch_ord").cast("bigint"))


@query("rehydrated_selection", "SQ-12", POOL_SQL + """, u AS (SELECT branch_ord, pool_rank, generate_subscripts([1,2],1) AS k FROM pool WHERE pool_rank <= 9)
SELECT branch_ord::BIGINT AS branch_ord, chunk_id, (9-pool_rank)::BIGINT AS pos FROM pool WHERE pool_rank <= 9""")
def _(spark, sf):
    p = pool(spark, sf).select("branch_ord", F.col("pool_rank").alias("short_id"), "chunk_id")
    answers = p.select("branch_ord").distinct().withColumn(
        "response", F.lit("[9] [8] [7] [6] [5] [4] [3] [2] [1] [9] [99999]"))
    return X.rehydrate(answers, p).select(F.col("branch_ord").cast("bigint").alias("branch_ord"), "chunk_id",
                                          F.col("pos").cast("bigint").alias("pos"))


ITEM_SQL = POOL_SQL + f""", it0 AS (SELECT *, {hay_sql('clean', 'source')} AS hay, {class_sql('clean')} AS evidence_class FROM pool),
 it1 AS (SELECT *, {kind_sql('', '')} AS source_kind FROM it0), items AS (SELECT * FROM it1 WHERE evidence_class='substantive' OR branch_ord NOT IN (SELECT branch_ord FROM it1 WHERE evidence_class='substantive'))"""


@query("extraction_items", "EX-3 EX-4", ITEM_SQL + " SELECT branch_name, chunk_id, source_kind, evidence_class, priority_weight > 1 AS addendum_override, md5(clean) AS text_hash FROM items")
def _(spark, sf):
    return X.items(pool(spark, sf)).select("branch_name", "chunk_id", "source_kind", "evidence_class", "addendum_override",
                                           F.md5("text").alias("text_hash"))


def deduped(spark, sf):
    """Items of whole branches, without a retrieval depth."""
    return X.cap_items(X.dedup_items(X.items(pool(spark, sf, None), stored=True)), BRANCHES)


_LIMITS = "CASE branch_ord " + " ".join(f"WHEN {i} THEN {b.max_items}" for i, b in enumerate(BRANCHES)) + " END"


def _greedy_sql(source: str, name: str, order: str, threshold: float, between: str) -> str:
    """``name`` as the greedy survivors g of ``source`` (tokens, ...) numbered by ``order``, with pairs ``name``_p."""
    return f"""{name}_d AS (SELECT *, row_number() OVER (ORDER BY {order}) AS g FROM {source}),
 {name}_t AS (SELECT g, branch_ord, len(tokens) AS n, unnest(tokens) AS t FROM {name}_d),
 {name}_p AS (SELECT a.g AS a, b.g AS b, count(*)::DOUBLE/(a.n+b.n-count(*)) AS s FROM {name}_t a JOIN {name}_t b ON a.t=b.t AND a.branch_ord {between} b.branch_ord
   AND a.g<b.g AND a.n >= {threshold - 0.01}*b.n AND b.n >= {threshold - 0.01}*a.n GROUP BY a.g, b.g, a.n, b.n HAVING count(*)::DOUBLE/(a.n+b.n-count(*)) >= {threshold}),
 {name}_n AS (SELECT b AS g, list(a) AS l FROM {name}_p GROUP BY b),
 {name}_r AS (SELECT 0::BIGINT AS g, []::BIGINT[] AS kept UNION ALL SELECT r.g+1, CASE WHEN list_has_any(coalesce(l,[]), kept) THEN kept ELSE list_append(kept, r.g+1) END
   FROM {name}_r r LEFT JOIN {name}_n n ON n.g=r.g+1 WHERE r.g < (SELECT max(g) FROM {name}_d)),
 {name} AS (SELECT d.* FROM {name}_d d WHERE g IN (SELECT unnest(kept) FROM (SELECT kept FROM {name}_r ORDER BY g DESC LIMIT 1)))"""


DEDUP_SQL = (ITEM_SQL.replace(" WHERE pool_rank <= 500", "").replace("WITH ", "WITH RECURSIVE ", 1)
             + ", tok0 AS (SELECT *, list_distinct(regexp_extract_all(lower(clean),'[a-z0-9]+')) AS tk FROM items)"
             + ", tok AS (SELECT branch_ord, branch_name, chunk_id, pool_rank, priority_weight, CASE WHEN len(tk)=0 THEN [''] ELSE tk END AS tokens FROM tok0), "
             + _greedy_sql("tok", "own", "branch_ord, priority_weight DESC, pool_rank", X.ITEM_THRESHOLD, "=")
             + ", placed AS (SELECT branch_ord, branch_name, chunk_id, priority_weight, tokens, row_number() OVER (PARTITION BY branch_ord ORDER BY pool_rank) AS item_ord FROM own)"
             + f", kept AS (SELECT * FROM placed WHERE item_ord <= {_LIMITS})")


@query("branch_items_without_duplicates", "EX-5 EX-3", DEDUP_SQL + " SELECT branch_name, chunk_id, item_ord, priority_weight FROM kept")
def _(spark, sf):
    return deduped(spark, sf).select("branch_name", "chunk_id", "item_ord", "priority_weight")


CROSS_SQL = DEDUP_SQL + ", " + _greedy_sql("kept", "x", "priority_weight DESC, branch_ord, item_ord", X.CROSS_THRESHOLD, "<>") + """,
 lost AS (SELECT p.b, min(p.a) AS a FROM x_p p JOIN x ON x.g = p.a WHERE p.b NOT IN (SELECT g FROM x) GROUP BY p.b)
SELECT w.branch_name AS winner_branch, w.chunk_id AS winner_chunk, l.branch_name AS loser_branch, l.chunk_id AS loser_chunk, round(s,3) AS similarity, w.priority_weight AS winner_priority
FROM lost JOIN x_d w ON w.g=lost.a JOIN x_d l ON l.g=lost.b JOIN x_p p ON p.a=lost.a AND p.b=lost.b"""


@query("cross_branch_overrides", "EX-7", CROSS_SQL)
def _(spark, sf):
    return X.dedup_cross_branch(deduped(spark, sf))


@query("extraction_report", "EX-10 EX-11 EX-8c")
def _(spark, sf):
    d = deduped(spark, sf)
    return X.report_lines(X.without_losers(d, X.dedup_cross_branch(d)), BRANCHES, "Corpus")


LINES_SQL = POOL_SQL + f""", li AS (SELECT branch_ord, pool_rank, branch_name, chunk_id, lower(CASE WHEN chunk_id % 3 = 0 THEN branch_name ELSE upper(branch_name) END) AS k,
  '[chunk:'||chunk_id||'] ['||CASE WHEN chunk_id % 3 = 0 THEN branch_name ELSE upper(branch_name) END||'] [source:unknown] '||tx||' (p.'||(chunk_id % 9 + 1)||', '||source||')' AS line,
  tx FROM (SELECT *, array_to_string(regexp_extract_all(clean,'{V.NON_SPACE_SQL}+'),' ') AS tx FROM pool))"""


def lines(spark, sf):
    p = pool(spark, sf).withColumn("text", F.array_join(T.space_tokens(E.strip_wrappers(F.col("text"))), " "))
    p = p.withColumns({"branch_name": F.when(F.col("chunk_id") % 3 == 0, F.col("branch_name")).otherwise(F.upper("branch_name")),
                       "source_kind": F.lit("unknown"), "page_start": F.col("chunk_id") % 9 + 1, "item_ord": F.col("pool_rank")})
    return X.evidence_lines(p)


@query("evidence_lines", "FN-40", LINES_SQL + " SELECT branch_name, line, tx AS text, 'unknown' AS source_kind, '(p.'||(chunk_id % 9 + 1)||', '||regexp_extract(line,', ([a-z0-9]+)\\)$',1)||')' AS cite FROM (SELECT * REPLACE (CASE WHEN chunk_id % 3 = 0 THEN branch_name ELSE upper(branch_name) END AS branch_name) FROM li)")
def _(spark, sf):
    p = lines(spark, sf).withColumn("p", E.parse_pass_line(F.col("line")))
    return p.select("branch_name", "line", F.col("p.text").alias("text"), F.col("p.source_kind").alias("source_kind"),
                    F.col("p.citation_suffix").alias("cite"))


@query("distinct_evidence_lines", "EX-9 EX-8e", LINES_SQL + f""", n AS (SELECT *, lower({wrappers_sql('tx')}) AS norm, CASE WHEN chunk_id % 3 = 0 THEN branch_name ELSE upper(branch_name) END AS bn FROM li)
SELECT bn AS branch_name, arg_min(line, (branch_ord, pool_rank)) AS line, max((norm='' OR ({any_sql('norm', E.CROSS_REFERENCES)} AND length(norm)<180))::INT)::BIGINT AS bucket FROM n GROUP BY bn, norm""")
def _(spark, sf):
    return X.distinct_lines(lines(spark, sf)).select("branch_name", "line", F.col("bucket").cast("bigint").alias("bucket"))


@query("category_counts", "AG-18 EX-8a EX-8f", LINES_SQL + """ SELECT k AS key, arg_min(CASE WHEN chunk_id % 3 = 0 THEN branch_name ELSE upper(branch_name) END,(branch_ord,pool_rank)) AS name,
 count(DISTINCT line)::BIGINT AS item_count, count(DISTINCT chunk_id)::BIGINT AS chunks, 1::BIGINT AS kinds FROM li GROUP BY k""")
def _(spark, sf):
    return X.category_counts(lines(spark, sf)).select("key", "name", "item_count", "chunks", "kinds")


@query("routed_categories", "EX-8a", LINES_SQL + " SELECT line, CASE k WHEN 'safety' THEN 'SAFETY' WHEN 'site' THEN 'Site' END AS category FROM li")
def _(spark, sf):
    return X.route_categories(lines(spark, sf), ["SAFETY", "Site"]).select("line", "category")


@query("category_summaries", "EX-8b EX-8a SQ-8")
def _(spark, sf):
    """First sentences of the evidence of three categories, layer by layer, and of their summaries."""
    return extract.category_summaries(lines(spark, sf), ("Safety", "Controls", "Site"))


@query("suggested_branches", "EX-12", """WITH w AS (SELECT item_id, regexp_extract_all(text,'[A-Za-z]+') AS w FROM benchmark), v AS (SELECT * FROM w WHERE len(w) >= 4 AND item_id % 6 < 5)
SELECT item_id, 1::BIGINT AS position, w[1] AS name, 'keyword' AS mode, w[2]||','||w[3] AS keywords, '' AS topic FROM v
UNION ALL SELECT item_id, 2, w[4], 'semantic', '', array_to_string(w,' ') FROM v""")
def _(spark, sf):
    """Proposals worded from benchmark texts: bare, fenced, inside prose, inside an object, and no list at all."""
    w = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= 4)
    word = lambda i: F.get("w", F.lit(i))
    listed = F.concat(F.lit('[{"name": " '), word(0), F.lit(' ", "sample_keywords": ["'), word(1), F.lit('", " ", "'), word(2),
                      F.lit(' "], "description": "d"}, {"name": "  "}, {"mode": "keyword"}, {"name": "'), word(3),
                      F.lit('", "mode": "semantic", "sample_keywords": ["x"], "description": " '), F.array_join("w", " "), F.lit(' "}]'))
    kind = F.col("item_id") % 6
    answer = (F.when(kind == 0, listed).when(kind == 1, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
              .when(kind == 2, F.concat(F.lit("These fit:\n"), listed, F.lit("\nas asked."))).when(kind == 3, F.concat(F.lit('{"branches": '), listed, F.lit("}")))
              .when(kind == 4, F.concat(F.lit("```\n"), listed, F.lit("```"))).otherwise(F.concat(F.lit("none: "), F.array_join("w", " "))))
    return X.suggested_branches(w.select("item_id", answer.alias("response"))).withColumn("keywords", F.array_join("keywords", ","))


MOJI = ((". ", " â€œ Page 3 of 9 "), (", ", " [ TABLE ] â€¢ "))


def _moji_sql() -> str:
    e = "text"
    for a, b in MOJI:
        e = f"replace({e},'{a}','{b}')"
    for a, b in E.MOJIBAKE:
        e = f"replace({e},'{a}','" + b.replace("'", "''") + "')"
    return e


@query("cleaned_report_text", "FN-39 EX-8d", f"""WITH a AS (SELECT doc_id, text, {_moji_sql()} AS t FROM documents),
b AS (SELECT doc_id, text, {V.strip_sql(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,'(?im)^" + chr(92) + "s*Outreach" + chr(92) + ")" + chr(92) + "*" + chr(92) + "*" + chr(92) + "s*" + chr(92) + "[ TABLE " + chr(92) + "]" + chr(92) + "s*','','g'),'(?i)" + chr(92) + "[" + chr(92) + "s*TABLE" + chr(92) + "s*" + chr(92) + "]','','g'),'(?i)" + chr(92) + "bPage" + chr(92) + "s+" + chr(92) + "d+" + chr(92) + "s+of" + chr(92) + "s+" + chr(92) + "d+" + chr(92) + "b','','g'),'" + SP + "+',' ','g')")} AS cleaned FROM a),
v AS (SELECT *, regexp_replace(left(text, (n.k)::BIGINT),'{SP}+$','') AS v FROM b, (SELECT 1000000 AS k) n), w AS (SELECT *, {V.strip_sql("list_extract(string_split(v,chr(10)),-1)")} AS last FROM v)
SELECT doc_id, cleaned, CASE WHEN v='' THEN FALSE WHEN v LIKE '%...' OR v LIKE '%…' OR regexp_matches(v,'\\b(Source:|Figure|Appendix|Step\\s+\\d+|The result of these steps should look as shown in)\\s*$') THEN TRUE WHEN last='' THEN FALSE
 WHEN last IN ('*','-','+','•') OR regexp_matches(last,'^#{{1,6}}\\s+.+$') OR regexp_matches(last,'^\\*\\*[^*]+\\*\\*$') THEN TRUE WHEN regexp_matches(last,'[.!?)\\]"''`]$') THEN FALSE ELSE regexp_matches(last,'[A-Za-z0-9]$') END AS truncated FROM w""")
def _(spark, sf):
    t = T.replace_literals(F.col("text"), MOJI)
    return table(spark, sf, "documents").select("doc_id", E.clean_report_text(t, strip_footers=True).alias("cleaned"),
                                                E.looks_truncated(F.col("text")).alias("truncated"))



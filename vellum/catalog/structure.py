"""Sections, roles, chunks, merging, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import views as V
from vellum.catalog.registry import query, table
from vellum.functions import text as T, vocab
from vellum.operators import chunking as Ch, folds, structure as St

# Every line whose first word starts with A-M, N-R, S or T turns into a heading or page marker,
# so the given prose exercises levels, pages, empty sections and fallbacks.
MARK = [(r"(?m)^([A-M][a-z]*) ", "## {1}\n"), (r"(?m)^([N-R][a-z]*) ", "\n### {1} Contents\n"),
        (r"(?m)^([S][a-z]*) ", "# {1}\n\n"), (r"(?m)^(Th[a-z]*) ", "<!-- page:7 -->\n{1} | --- "),
        (r"(?m)^([U-W][a-z]*) ", "<!-- page:140 -->\n")]


def markdown(spark, sf):
    t = F.col("text")
    for p, r in MARK:
        t = F.regexp_replace(t, p, r.replace("{1}", "$1"))
    t = F.when(F.col("n_chars") % 7 == 0, F.concat(F.lit("---\ntitle: A: b\nlang: "), F.col("lang"), F.lit("\n---\n"), t)).otherwise(t)
    return table(spark, sf, "documents").select("doc_id", t.alias("text"))


def _mark_sql() -> str:
    e = "text"
    for p, r in MARK:
        lit = r.replace("{1}", "\\1").replace("\n", "'||chr(10)||'")
        e = f"regexp_replace({e},'{p}','{lit}','g')"
    return (f"md AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN '---'||chr(10)||'title: A: b'||chr(10)||'lang: '||lang||chr(10)||'---'||chr(10)||{e} ELSE {e} END AS text FROM documents)")


S = V.SPACE_SQL
strip = V.strip_sql
SEC_SQL = "WITH " + _mark_sql() + f""", ln0 AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS raw, generate_subscripts(string_split(text,chr(10)),1)-1 AS pos, text FROM md),
fm AS (SELECT doc_id, min(pos) AS endpos FROM ln0 WHERE pos>0 AND {strip('raw')}='---' AND starts_with(text,'---'||chr(10)) GROUP BY 1),
ln AS (SELECT l.doc_id, pos, regexp_replace(raw,'{S}+$','') AS line FROM ln0 l LEFT JOIN fm USING (doc_id) WHERE pos > COALESCE(endpos,-1)),
mk AS (SELECT *, regexp_extract({strip('line')},'^<!--\\s*page:(\\d+)\\s*-->\\s*$',1) AS pg, length(regexp_extract(line,'^(#{{1,6}})\\s+(.+?)\\s*$',1)) AS lvl, {strip("regexp_extract(line,'^(#{1,6})\\s+(.+?)\\s*$',2)")} AS ttl FROM ln),
fl AS (SELECT *, pg<>'' AS is_marker, pg='' AND lvl>0 AS is_heading, CASE WHEN pg<>'' THEN pg::INT END AS page FROM mk),
rw AS (SELECT *, sum(is_heading::INT) OVER w AS section_idx, last_value(page IGNORE NULLS) OVER w AS cur FROM fl WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
rb AS (SELECT *, NOT is_marker AND NOT is_heading AS body FROM rw WHERE section_idx>0),
rg AS (SELECT *, COALESCE(lag(line='') OVER (PARTITION BY doc_id, section_idx, body ORDER BY pos),FALSE) AS gap FROM rb),
sg AS (SELECT doc_id, section_idx, max(ttl) FILTER (WHERE is_heading) AS title, max(lvl) FILTER (WHERE is_heading) AS level, max(cur) FILTER (WHERE is_heading) AS first_page, arg_max(cur,pos) AS am, max(pos) AS mp,
 string_agg(CASE WHEN gap THEN chr(10) ELSE '' END||line, chr(10) ORDER BY pos) FILTER (WHERE body AND line<>'') AS c FROM rg GROUP BY 1,2),
se AS (SELECT sg.*, r.cur AS page_end FROM sg JOIN rg r ON r.doc_id=sg.doc_id AND r.pos=sg.mp),
sc AS (SELECT doc_id, section_idx, title, level, COALESCE(first_page,page_end) AS page_start, page_end, COALESCE({strip('c')},'') AS content FROM se),
si AS (SELECT *, 's'||lpad(section_idx::VARCHAR,4,'0')||'-'||CASE WHEN regexp_replace(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'^-+|-+$','','g')='' THEN 'section' ELSE regexp_replace(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') END AS section_id FROM sc),
anc AS (SELECT a.doc_id, a.section_idx, x.section_idx AS xi, x.title AS xt, x.section_id AS xid FROM si a JOIN si x ON x.doc_id=a.doc_id AND x.section_idx<a.section_idx AND x.level<a.level
 WHERE NOT EXISTS (SELECT 1 FROM si y WHERE y.doc_id=a.doc_id AND y.section_idx>x.section_idx AND y.section_idx<a.section_idx AND y.level<=x.level)),
pa AS (SELECT doc_id, section_idx, string_agg(xt,' > ' ORDER BY xi) AS ppath, arg_max(xid,xi) AS parent_id FROM anc GROUP BY 1,2),
sections AS (SELECT si.doc_id, si.section_idx::BIGINT AS section_idx, si.section_id, title, level::BIGINT AS level, parent_id, CASE WHEN ppath IS NULL THEN title ELSE ppath||' > '||title END AS path_text, content,
 page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, contains(content,'|') AND contains(content,'---') AS has_table FROM si LEFT JOIN pa ON pa.doc_id=si.doc_id AND pa.section_idx=si.section_idx)"""


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


@query("markdown_sections", "SQ-1 WN-10 WN-11", SEC_SQL + " SELECT * FROM sections")
def _(spark, sf):
    return _long(St.sections(markdown(spark, sf)), "section_idx", "level", "page_start", "page_end")


@query("frontmatter_fields", "SQ-1", "WITH " + _mark_sql() + """ SELECT doc_id, 'title' AS key, 'A: b' AS value FROM documents WHERE n_chars % 7 = 0
UNION ALL SELECT doc_id, 'lang', lang FROM documents WHERE n_chars % 7 = 0""")
def _(spark, sf):
    return St.frontmatter(markdown(spark, sf))


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col},'{w}')" for w in words) + ")"


ROLE_SQL = f"""CASE WHEN COALESCE(page_start,9999) <= 8 AND {_any_sql('lower(content)', vocab.ROLE_METADATA_CONTENT)} THEN 'metadata'
 WHEN {_any_sql('lower(title)', vocab.ROLE_METADATA_TITLE)} THEN 'metadata' WHEN contains(lower(path_text),'copyright') AND COALESCE(page_start,9999) <= 12 THEN 'metadata'
 WHEN trim(lower(title)) IN {V.in_sql(vocab.ROLE_INDEX_TITLE)} THEN 'index_noise' WHEN COALESCE(page_start,9999) >= 130 AND {_any_sql('lower(title)', vocab.ROLE_INDEX_TITLE)} THEN 'index_noise'
 WHEN contains(lower(title),'table of contents') OR lower(title)='contents' THEN 'heading_overview'
 WHEN COALESCE(page_start,9999) <= 30 AND ({_any_sql('lower(title)', vocab.ROLE_FRONTMATTER_TITLE)} OR {_any_sql('lower(path_text)', vocab.ROLE_FRONTMATTER_TITLE)}) THEN 'frontmatter'
 WHEN has_table THEN 'table_data' ELSE 'body' END"""


@query("enriched_sections", "FN-19 FN-20 SQ-15", SEC_SQL + f""" SELECT doc_id, section_id, {ROLE_SQL} AS structural_role, length(content)::BIGINT AS char_count, {V.word_count_sql('content')}::BIGINT AS word_count,
 array_to_string(list_filter([CASE WHEN content='' THEN 'empty_content' END, CASE WHEN length(content)<80 THEN 'short_content' END, CASE WHEN contains(content,'�') THEN 'encoding_artifact' END,
 CASE WHEN contains(content,'  ') THEN 'double_spaces' END, CASE WHEN page_start IS NULL THEN 'missing_page' END], lambda x: x IS NOT NULL),',') AS quality_flags FROM sections""")
def _(spark, sf):
    e = St.enrich(St.sections(markdown(spark, sf)))
    return e.select("doc_id", "section_id", "structural_role", "char_count", "word_count",
                    F.array_join("quality_flags", ",").alias("quality_flags"))


@query("section_statistics", "SQ-15", SEC_SQL + """ SELECT doc_id, count(*)::BIGINT AS section_count, count(*) FILTER (WHERE has_table)::BIGINT AS sections_with_tables,
 count(*) FILTER (WHERE content='')::BIGINT AS empty_sections FROM sections GROUP BY 1""")
def _(spark, sf):
    return St.document_stats(St.enrich(St.sections(markdown(spark, sf))))


@query("fallback_sections", "SQ-16", SEC_SQL + f""", pre AS (SELECT doc_id, {strip("string_agg(line, chr(10) ORDER BY pos)")} AS preamble FROM rw WHERE section_idx=0 AND NOT is_marker GROUP BY 1)
SELECT doc_id, section_id, length(content)::BIGINT AS chars FROM sections UNION ALL
SELECT doc_id, 's0000', length(preamble)::BIGINT FROM pre WHERE preamble<>'' AND doc_id NOT IN (SELECT doc_id FROM sections)""")
def _(spark, sf):
    md = markdown(spark, sf)
    return St.with_fallback_section(md, St.sections(md)).select(
        "doc_id", "section_id", F.length("content").cast("bigint").alias("chars"))


# --- packing ------------------------------------------------------------------------------
def _est(e: str) -> str:
    return "(" + V.estimate_sql(e) + ")"


def _charcap(lst: str, width: int = 4000) -> str:
    return (f"flatten(list_transform({lst}, lambda c: CASE WHEN length(c) <= {width} THEN [c] ELSE list_transform(range(0, ceil(length(c)/{width}::DOUBLE)::BIGINT), "
            f"lambda i: substring(c, (i*{width}+1)::BIGINT, {width})) END))")


def _pieces(e: str, pat: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({e},'{pat}'), lambda s: {strip('s')}), lambda s: length(s)>0)"


# RE2 has no look-behind: mark sentence ends first, then split on the mark.
def _sent(e: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({e},'([.!?])[ \\t]+','\\1'||chr(1),'g'),chr(1)), lambda s: {strip('s')}), lambda s: length(s)>0)"


def _unit(t: str, scope: str, solid: str, sep: str) -> str:
    return f"{{'done': []::VARCHAR[], 'cur': {t}, 'size': {_est(t)}::BIGINT, 'scope': ({scope})::BIGINT, 'solid': {solid}, 'sep': {sep}}}"


def _words(s: str, n: int) -> str:
    w = f"regexp_extract_all({s},'{V.NON_SPACE_SQL}+')"
    joined = f"list_transform(range(0, greatest(1,ceil(len({w})/{n}::DOUBLE))::BIGINT), lambda j: array_to_string({w}[(j*{n}+1):((j+1)*{n})],' '))"
    return (f"flatten(list_transform({joined}, lambda q: CASE WHEN length(q)<=4000 THEN [q] ELSE list_transform(range(0, ceil((length(q)-200)/3800::DOUBLE)::BIGINT), lambda z: substring(q,(z*3800+1)::BIGINT,4000)) END))")


NL2 = "chr(10)||chr(10)"


def _segments_sql(text: str, budget: int) -> str:
    n = max(20, int(budget / 1.3))
    sents = (f"flatten(list_transform({_sent('p')}, lambda s: CASE WHEN {_est('s')} > {budget} THEN list_transform({_words('s', n)}, lambda w: {_unit('w', 'i', 'TRUE', chr(39)+' '+chr(39))}) "
             f"ELSE [{_unit('s', 'i', 'FALSE', chr(39)+' '+chr(39))}] END))")
    paras = _pieces(text, "\\n{2,}")
    units = f"flatten(list_transform({paras}, lambda p, i: CASE WHEN {_est('p')} > {budget} THEN {sents} ELSE [{_unit('p', '-1', 'FALSE', NL2)}] END))"
    return _pack_sql(units, budget)


def _pack_sql(units: str, budget: int) -> str:
    close = f"(a.scope<>u.scope OR a.solid OR u.solid OR a.size+u.size > {budget})"
    red = (f"list_reduce({units}, lambda a, u: {{'done': CASE WHEN {close} THEN list_append(a.done,a.cur) ELSE a.done END, 'cur': CASE WHEN {close} THEN u.cur ELSE a.cur||u.sep||u.cur END, "
           f"'size': CASE WHEN {close} THEN u.size ELSE a.size+u.size END, 'scope': u.scope, 'solid': CASE WHEN {close} THEN u.solid ELSE FALSE END, 'sep': u.sep}})")
    return red


MIX_SQL = """mix AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, '.'||chr(10), '.'||chr(10)||chr(10)) ELSE replace(replace(text,'. ',' '), chr(10), ' ') END AS text FROM documents)"""


def mixed(spark, sf):
    t, k = F.col("text"), F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", F.when(k == 0, t).when(
        k == 1, F.replace(t, F.lit(".\n"), F.lit(".\n\n"))).otherwise(
        T.replace_literals(t, [(". ", " "), ("\n", " ")])).alias("text"))


PLAIN_SQL = f"""WITH {MIX_SQL}, r AS (SELECT doc_id, CASE WHEN len({_pieces('text', chr(92) + 'n{2,}')})=0 THEN NULL ELSE {_segments_sql('text', 120)} END AS a FROM mix),
s AS (SELECT doc_id, CASE WHEN a IS NULL THEN []::VARCHAR[] ELSE {_charcap('list_append(a.done,a.cur)')} END AS segs FROM r),
e AS (SELECT doc_id, unnest(segs) AS text, generate_subscripts(segs,1)-1 AS idx FROM s)"""


@query("plain_text_chunks", "SQ-3 SQ-14 SQ-5", PLAIN_SQL + f""" SELECT doc_id::VARCHAR||'-c'||lpad(idx::VARCHAR,6,'0') AS chunk_id, doc_id, idx::BIGINT AS idx, {_est('text')}::BIGINT AS token_count_est, text FROM e""")
def _(spark, sf):
    c = Ch.chunk_plain_text(mixed(spark, sf).withColumn("title", F.lit("")), 120).drop("title")
    return _long(c, "idx", "token_count_est")


CHUNK_SQL = SEC_SQL + f""", en AS (SELECT *, {ROLE_SQL} AS role FROM sections WHERE content<>''),
 g AS (SELECT *, CASE WHEN has_table THEN CASE WHEN {_est('content')} <= 240 AND length(content) <= 4000 THEN {{'done': []::VARCHAR[], 'cur': content, 'size': 0::BIGINT, 'scope': (-1)::BIGINT, 'solid': FALSE, 'sep': ''}}
   ELSE {_pack_sql(f"list_transform({_pieces('content', chr(92) + 'n{2,}')}, lambda p: {_unit('p', '-1', 'FALSE', NL2)})", 240)} END
   ELSE {_segments_sql('content', 120)} END AS a FROM en),
 sp AS (SELECT *, {_charcap('list_append(a.done,a.cur)')} AS segs FROM g), ex AS (SELECT * EXCLUDE (a, segs), unnest(segs) AS segment, generate_subscripts(segs,1) AS part FROM sp),
 kp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_idx, part)-1 AS idx, CASE WHEN title<>'' THEN title||{NL2} ELSE '' END||CASE WHEN has_table THEN '[ TABLE ]'||chr(10) ELSE '' END||segment AS text
   FROM ex WHERE NOT ({V.word_count_sql('segment')} < 4 OR len(regexp_extract_all(segment,'[a-zA-Z]{{3,}}')) < 3)),
 chunks AS (SELECT doc_id::VARCHAR||'-c'||lpad(idx::VARCHAR,6,'0') AS chunk_id, doc_id, section_id, page_start, page_end,
  CASE WHEN role='body' AND (regexp_matches(title,'{vocab.BIBLIOGRAPHY_TITLE}') OR regexp_matches(path_text,'{vocab.BIBLIOGRAPHY_TITLE}')) THEN 'bibliography' ELSE role END AS structural_role,
  {_est('text')}::BIGINT AS token_count_est, {V.word_count_sql('text')}::BIGINT AS word_count, idx::BIGINT AS idx, text FROM kp)"""


def chunked(spark, sf):
    return Ch.chunk_sections(St.enrich(St.sections(markdown(spark, sf))), 120)


@query("document_chunks", "SQ-2 SQ-4 FN-17 FN-18", CHUNK_SQL + " SELECT * FROM chunks")
def _(spark, sf):
    c = chunked(spark, sf).select("chunk_id", "doc_id", "section_id", "page_start", "page_end", "structural_role",
                                  "token_count_est", "word_count", "idx", "text")
    return _long(c, "page_start", "page_end", "token_count_est", "word_count", "idx")


def _merge_reduce(lst: str, absorb: str, base: str, extra: dict[str, str]) -> str:
    """One merging pass as a list fold over structs that carry their finished list."""
    cols = ("chunk_id", "section_id", "page_start", "page_end", "token_count_est", "word_count", "text")
    m = f"({absorb} AND a.section_id=u.section_id AND a.token_count_est+u.token_count_est <= 200)"
    joined = {"text": strip(f"regexp_replace(a.text,'{S}+$','')||{NL2}||regexp_replace(u.text,'^{S}+','')"),
              "token_count_est": "a.token_count_est+u.token_count_est", "word_count": "a.word_count+u.word_count", **extra}
    body = ", ".join(f"'{c}': CASE WHEN {m} THEN {joined.get(c, base + '.' + c)} ELSE u.{c} END" for c in cols)
    keep = "{" + ", ".join(f"'{c}': a.{c}" for c in cols) + "}"
    return f"list_reduce({lst}, lambda a, u: {{'done': CASE WHEN {m} THEN a.done ELSE list_append(a.done, {keep}) END, {body}}})"


_COLS = ("chunk_id", "section_id", "page_start", "page_end", "token_count_est", "word_count", "text")
_TYPE = "STRUCT(chunk_id VARCHAR, section_id VARCHAR, page_start BIGINT, page_end BIGINT, token_count_est BIGINT, word_count BIGINT, text VARCHAR)[]"
_ITEM = "{'done': []::" + _TYPE + ", " + ", ".join(f"'{c}': {c}" for c in _COLS) + "}"
_LAST = "{" + ", ".join(f"'{c}': r.{c}" for c in _COLS) + "}"
_REWRAP = "{'done': []::" + _TYPE + ", " + ", ".join(f"'{c}': x.{c}" for c in _COLS) + "}"
MERGE_SQL = CHUNK_SQL + f""", l AS (SELECT doc_id, list({_ITEM} ORDER BY idx) AS items FROM chunks GROUP BY doc_id),
 p1 AS (SELECT doc_id, {_merge_reduce('items', 'u.token_count_est < 40', 'a', {'page_end': 'u.page_end'})} AS r FROM l),
 i2 AS (SELECT doc_id, list_transform(list_append(r.done, {_LAST}), lambda x: {_REWRAP}) AS items FROM p1),
 p2 AS (SELECT doc_id, {_merge_reduce('items', 'a.token_count_est < 40', 'u', {'chunk_id': 'a.chunk_id', 'page_start': 'a.page_start'})} AS r FROM i2),
 o AS (SELECT doc_id, unnest(list_append(r.done, {_LAST})) AS c FROM p2)
SELECT doc_id, c.chunk_id AS chunk_id, c.section_id AS section_id, c.page_start AS page_start, c.page_end AS page_end, c.token_count_est AS token_count_est, c.word_count AS word_count, c.text AS text FROM o"""


@query("merged_small_chunks", "SQ-9", MERGE_SQL)
def _(spark, sf):
    m = Ch.merge_small(chunked(spark, sf), 40, 200)
    return _long(m.select("doc_id", "chunk_id", "section_id", "page_start", "page_end", "token_count_est", "word_count", "text"),
                 "page_start", "page_end", "token_count_est", "word_count")


@query("fixed_stride_windows", "SQ-5", """WITH w AS (SELECT doc_id, text, CASE WHEN length(text)<=900 THEN 1 ELSE ceil((length(text)-160)/740::DOUBLE)::BIGINT END AS n FROM documents),
 e AS (SELECT doc_id, text, unnest(range(0,n)) AS i FROM w) SELECT doc_id, i::BIGINT AS idx, substring(text,(i*740+1)::BIGINT,900) AS part FROM e""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(folds.char_windows(F.col("text"), 900, 160)).alias("idx", "part")).withColumn(
        "idx", F.col("idx").cast("bigint"))


@query("simulated_pages", "SQ-5", """WITH w AS (SELECT doc_id, text, length(text) AS n, greatest(2000, floor(length(text)/greatest(1,length(text)//3500)::DOUBLE))::BIGINT AS size FROM documents),
 e AS (SELECT *, unnest(CASE WHEN n<=5250 THEN [0] ELSE range(0, ceil(n/size::DOUBLE)::BIGINT) END) AS i FROM w)
SELECT doc_id, i::BIGINT AS page, CASE WHEN n<=5250 THEN text ELSE substring(text,(i*size+1)::BIGINT,size) END AS part FROM e""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(folds.simulated_pages(F.col("text"))).alias("page", "part")).withColumn(
        "page", F.col("page").cast("bigint"))


@query("chunk_neighbours", "JN-11", CHUNK_SQL + """, n AS (SELECT a.chunk_id, b.chunk_id AS neighbour_id, (b.idx-a.idx)::BIGINT AS "offset" FROM chunks a JOIN chunks b ON a.doc_id=b.doc_id AND b.idx-a.idx IN (-2,-1,1,2))
SELECT * FROM n""")
def _(spark, sf):
    c = chunked(spark, sf).select("chunk_id")
    return Ch.neighbours(c, c, 2).select("chunk_id", "neighbour_id", F.col("offset").cast("bigint").alias("offset"))


@query("page_artifact_replacements", "JN-13 SQ-10", V.LIBRARY_SQL + """, art AS (SELECT 'd'||(user_id*10)::VARCHAR AS doc_id, (event_id % 400)::INT AS page, event_id AS ai, event_type AS kind, 'A'||(event_id % 7)::VARCHAR AS t FROM events WHERE event_type IN ('click','view')),
 pg AS (SELECT chunk_id, doc_id, unnest(range(page_start, page_end+1)) AS page FROM chunks WHERE page_start IS NOT NULL),
 j AS (SELECT chunk_id, t, min((p.page, ai)) AS f FROM pg p JOIN art a ON a.doc_id=p.doc_id AND a.page=p.page GROUP BY 1,2),
 n AS (SELECT chunk_id, string_agg(t, chr(10)||chr(10) ORDER BY f) AS new FROM j GROUP BY 1)
SELECT c.chunk_id, COALESCE(n.new, c.text) AS text FROM chunks c LEFT JOIN n USING (chunk_id)""")
def _(spark, sf):
    a = table(spark, sf, "events").where("event_type IN ('click','view','error')").select(
        F.concat(F.lit("d"), (F.col("user_id") * 10).cast("string")).alias("doc_id"),
        (F.col("event_id") % 400).cast("int").alias("page_number"), F.col("event_id").alias("artifact_index"),
        F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "view", "form").otherwise("table").alias("artifact_kind"),
        F.concat(F.lit("A"), (F.col("event_id") % 7).cast("string")).alias("replacement_text"))
    return Ch.apply_page_replacements(V.library_chunks(spark, sf), a).select("chunk_id", "text")


SEG_SQL = """l AS (SELECT conv_id, list(length(text)::BIGINT ORDER BY turn) AS lens, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)"""


@query("equal_length_segments", "SQ-6 WN-8", f"""WITH {SEG_SQL}, t AS (SELECT *, list_sum(lens)/3::DOUBLE AS target FROM l),
 r AS (SELECT conv_id, turns, list_reduce(list_transform(lens, lambda x: {{'u': x, 'seg': 1::BIGINT, 'o': []::BIGINT[]}}), lambda a, x: {{'u': CASE WHEN a.u >= target AND a.seg-1 < 2 THEN x.u ELSE a.u + x.u END,
  'seg': CASE WHEN a.u >= target AND a.seg-1 < 2 THEN a.seg+1 ELSE a.seg END, 'o': list_append(a.o, CASE WHEN a.u >= target AND a.seg-1 < 2 THEN a.seg+1 ELSE a.seg END)}}) AS z FROM t)
SELECT conv_id, unnest(turns) AS turn, unnest(list_prepend(1::BIGINT, z.o)) AS segment FROM r""")
def _(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", F.length("text").cast("bigint").alias("n")))).alias("m"))
    nums = folds.segment_numbers(F.transform("m", lambda s: s["n"]), F.lit(3))
    z = F.arrays_zip(F.transform("m", lambda s: s["turn"]).alias("turn"), nums.alias("segment"))
    return g.select("conv_id", F.explode(z).alias("z")).select("conv_id", "z.turn", F.col("z.segment").cast("bigint").alias("segment"))


@query("even_text_sample", "SQ-7", f"""WITH w AS (SELECT doc_id, regexp_extract_all(text,'{V.NON_SPACE_SQL}+') AS ws FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(ws)<=12 THEN ws ELSE list_transform(range(0,12), lambda i: ws[floor(i*(len(ws)/12::DOUBLE))::BIGINT+1]) END,' ') AS sample FROM w""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.space_tokens(F.col("text")).alias("ws"))
    return d.select("doc_id", F.array_join(folds.even_sample(F.col("ws"), F.lit(12)), " ").alias("sample"))

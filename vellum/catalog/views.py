"""The given tables seen as the document model, in Spark and in SQL.

customer = documents, orders = their chunks, nation/region = the two-level
collection tree, conversations = messages, events = run log, documents = text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.catalog.registry import table
from vellum.functions import text as T

DOC_TYPES = {"AUTOMOBILE": "pdf_book", "BUILDING": "pdf_paper", "FURNITURE": "docx",
             "MACHINERY": "notes", "HOUSEHOLD": "web"}
ROLES = {"1-URGENT": "toc", "2-HIGH": "introduction", "3-MEDIUM": "document_summary",
         "4-NOT SPECIFIED": "body", "5-LOW": "index_noise"}


def _case(col, mapping: dict[str, str]):
    out = F
    for k, v in mapping.items():
        out = out.when(col == k, F.lit(v))
    return out.otherwise(F.lit("general"))


def _case_sql(col: str, mapping: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {col}='{k}' THEN '{v}'" for k, v in mapping.items()) + " ELSE 'general' END"


def library_docs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc_id"),
        F.concat("c_name", F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("/lib/"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_name",
                 F.lit(".pdf")).alias("source_path"),
        _case(seg, DOC_TYPES).alias("source_type"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
        .alias("collection_id"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit('{"title": "T '), "c_name", F.lit('"}')))
        .alias("metadata_json"),
        F.when(F.col("c_acctbal") > 2000, F.md5("c_name")).alias("file_hash"))


DOCS_SQL = f"""docs AS (SELECT 'd'||c_custkey::VARCHAR AS doc_id, c_name||'.pdf' AS filename,
  '/lib/'||c_nationkey::VARCHAR||'/'||c_name||'.pdf' AS source_path,
  {_case_sql('c_mktsegment', DOC_TYPES)} AS source_type,
  CASE WHEN c_acctbal >= 0 THEN 'n'||c_nationkey::VARCHAR END AS collection_id,
  CASE WHEN c_acctbal > 5000 THEN '{{"title": "T '||c_name||'"}}' END AS metadata_json,
  CASE WHEN c_acctbal > 2000 THEN md5(c_name) END AS file_hash FROM customer)"""


def library_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = library_docs(spark, sf).select("doc_id", "collection_id", "source_type", "filename")
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("doc_id"),
        F.concat(F.lit("d"), F.col("o_custkey").cast("string"), F.lit("-c"),
                 F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("chunk_id"),
        _case(F.col("o_orderpriority"), ROLES).alias("structural_role"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 400).cast("int")).alias("page_start"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 400 + 3).cast("int")).alias("page_end"),
        (F.col("o_totalprice") > 400000).alias("has_table"),
        F.floor(F.col("o_totalprice") / 500).cast("int").alias("token_count_est"),
        F.concat("o_orderpriority", F.lit(" > "), "o_orderstatus").alias("path_text"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Title "), F.col("o_custkey").cast("string")))
        .alias("document_title"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" text ")).alias("text"))
    return o.join(docs, "doc_id", "left")


CHUNKS_SQL = f"""chunks AS (SELECT 'd'||o_custkey::VARCHAR AS doc_id,
  'd'||o_custkey::VARCHAR||'-c'||lpad(o_orderkey::VARCHAR, 9, '0') AS chunk_id,
  {_case_sql('o_orderpriority', ROLES)} AS structural_role,
  CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 400)::INT END AS page_start,
  CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 400 + 3)::INT END AS page_end,
  o_totalprice > 400000 AS has_table, floor(o_totalprice/500)::INT AS token_count_est,
  o_orderpriority||' > '||o_orderstatus AS path_text,
  CASE WHEN o_orderstatus='F' THEN 'Title '||o_custkey::VARCHAR END AS document_title,
  ' '||o_orderpriority||' text ' AS text, d.collection_id, d.source_type, d.filename
  FROM orders LEFT JOIN docs d ON d.doc_id = 'd'||o_custkey::VARCHAR)"""


def library_collections(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("collection_id"),
        F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    nations = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("collection_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    return regions.unionByName(nations)


COLLECTIONS_SQL = """collections AS (
  SELECT 'r'||r_regionkey::VARCHAR AS collection_id, r_name AS name, NULL::VARCHAR AS parent_id FROM region
  UNION ALL SELECT 'n'||n_nationkey::VARCHAR, n_name, 'r'||n_regionkey::VARCHAR FROM nation)"""

LIBRARY_SQL = f"WITH {DOCS_SQL}, {CHUNKS_SQL}, {COLLECTIONS_SQL}"


CORPUS_ROLES = {"en": "body", "de": "toc", "fr": "frontmatter", "es": "metadata"}


# --- text corpus ------------------------------------------------------------------
def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents as retrievable chunks: the first word is the title, ``lang > source`` the path."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text",
        F.regexp_extract("text", r"^[A-Za-z]+", 0).alias("title"),
        F.concat("lang", F.lit(" > "), "source").alias("path_text"),
        F.col("lang").alias("source_type"), "n_chars",
        _case(F.col("lang"), CORPUS_ROLES).alias("structural_role"),
        (F.col("n_chars") % 60).cast("int").alias("page_start"),
        T.estimate_tokens(F.col("text")).alias("token_count_est"),
        F.contains("text", F.lit("|")).alias("has_table"))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CORPUS_SQL = """corpus AS (SELECT doc_id AS chunk_id, source AS doc_id, text,
  regexp_extract(text, '^[A-Za-z]+') AS title, lang||' > '||source AS path_text,
  lang AS source_type, n_chars, {role} AS structural_role, (n_chars % 60)::INT AS page_start,
  {est} AS token_count_est, contains(text,'|') AS has_table FROM documents)"""

# RE2 has no Unicode switch, so the same characters are listed one by one.
_SPACES = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NON_SPACE_SQL = f"[^{_SPACES}]"
SPACE_SQL = f"[{_SPACES}]"


def tokens_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[A-Za-z][A-Za-z0-9_\\-\\.]+')"


def list_sql(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def in_sql(words) -> str:
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def word_count_sql(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{NON_SPACE_SQL}+'))"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def estimate_sql(expr: str) -> str:
    w = word_count_sql(expr)
    return (f"CASE WHEN {w} = 0 THEN 0 ELSE greatest(floor({w} * 1.3::DOUBLE)::BIGINT, "
            f"length({expr}) // 3, 1) END")


CORPUS_SQL = CORPUS_SQL.replace("{role}", _case_sql("lang", CORPUS_ROLES)).replace("{est}", estimate_sql("text"))
QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

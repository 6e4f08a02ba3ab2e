"""Reading documents, question lists, feeds and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vellum import schemas
from vellum.functions import pages, text as T

# Readable text extensions and what they count as.
TEXT_EXTENSIONS = (
    ".txt .md .rst .py .js .ts .jsx .tsx .java .c .cpp .h .hpp .cs .go .rb .php .sh .bash .zsh .yaml .yml "
    ".json .toml .ini .cfg .csv .html .htm .xml .css .scss .sql .r .m .tex .bib .docx").split()
CODE_EXTENSIONS = (".py .js .ts .jsx .tsx .java .c .cpp .h .hpp .cs .go .rb .php .sh .bash .zsh .sql .r .m").split()


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))


def source_type(ext: Column) -> Column:
    return (F.when(ext.isin(CODE_EXTENSIONS), "code").when(ext.isin(".md", ".rst"), "notes")
            .when(ext == ".docx", "docx").otherwise("text"))


def artifact_stem(doc_id: Column, filename: Column, width: int = 72) -> Column:
    """Short id and a file-system-safe base name."""
    base = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r'[<>:"/\\|?*]+', "_")
    base = F.regexp_replace(F.regexp_replace(base, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    return F.concat(F.substring(doc_id, 1, 12), F.lit("_"), F.substring(F.when(base == "", "document").otherwise(base), 1, width))


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as documents: id is the SHA-256 of the bytes, type comes from the extension.

    Files of other kinds are left out by extension after listing, before reading content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    ext = extension(F.col("path"))
    readable = [e for e in TEXT_EXTENSIONS if e != ".docx"]
    return files.where(ext.isin(readable)).select(
        F.sha2("content", 256).alias("doc_id"), F.col("path").alias("source_path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"), source_type(ext).alias("source_type"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("file_hash"))


def binary_documents(spark: SparkSession, path: str, extract, glob: str = "*.pdf") -> DataFrame:
    """Documents needing a format library: ``extract(bytes) -> markdown`` runs in Arrow batches."""
    import pandas as pd
    from pyspark.sql import types as ST

    @F.pandas_udf(ST.StringType())
    def to_markdown(content: pd.Series) -> pd.Series:
        return content.map(extract)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("doc_id"), F.col("path").alias("source_path"),
                        F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit("pdf_book").alias("source_type"),
                        to_markdown("content").alias("text"))


def text_directory(spark: SparkSession, path: str, globs: tuple[str, ...] = ("*.md", "*.txt")) -> DataFrame:
    out = None
    for g in globs:
        d = text_files(spark, path, g)
        out = d if out is None else out.unionByName(d)
    return out


QA = "struct<question:string,answer:string>"


def question_answer_rows(raw: DataFrame) -> DataFrame:
    """(source, pos, title, text) from JSON texts that are an array of pairs or ``{"items": [...]}``.

    Blank pairs go; ids keep the original position.
    """
    body = F.col("value")
    listed = F.from_json(body, f"array<{QA}>")
    wrapped = F.from_json(body, f"struct<items:array<{QA}>>")["items"]
    rows = raw.select("source", F.posexplode(F.when(F.ltrim(body).startswith("["), listed).otherwise(wrapped)).alias("pos", "qa"))
    q, a = T.strip(F.col("qa.question")), T.strip(F.col("qa.answer"))
    return rows.where((q != "") & (a != "")).select(
        "source", "pos", q.alias("title"), F.concat(F.lit("Q: "), q, F.lit("\nA: "), a).alias("text"))


def question_answer_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    rows = question_answer_rows(raw)
    key = F.concat(F.lit("qa:"), "source", F.lit("#"), F.col("pos").cast("string"))
    return rows.select(F.sha2(key, 256).alias("doc_id"), F.col("source").alias("source_path"), "title", "text",
                       F.lit("qa").alias("source_type"))


def feed_items(feeds: DataFrame, most: int = 10) -> DataFrame:
    """(feed_id, url, title, snippet, pos) of RSS items: http(s) links only, first of each url, first ``most``."""
    items = F.regexp_extract_all("xml", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))

    def tag(name: str) -> Column:
        raw = F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return T.strip(F.regexp_replace(pages.unescape_entities(F.regexp_replace(raw, r"<!\[CDATA\[|\]\]>", "")), r"\s+", " "))

    rows = feeds.select("feed_id", F.posexplode(items).alias("pos", "item")).select(
        "feed_id", "pos", tag("link").alias("url"), tag("title").alias("title"), tag("description").alias("snippet"))
    ok = rows.where(F.col("url").rlike("^https?://") & ~pages.host(F.col("url")).contains("bing.com"))
    first = ok.groupBy("feed_id", "url").agg(F.min_by(F.struct("pos", "title", "snippet"), "pos").alias("f"))
    # Feeds are single documents, so ranking inside one is bounded by its size.
    w = Window.partitionBy("feed_id").orderBy("pos")
    return first.select("feed_id", "url", "f.*").withColumn("position", F.row_number().over(w).cast("bigint")).where(
        F.col("position") <= most)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run events from JSON lines; malformed lines are skipped."""
    return spark.read.schema(schemas.RUN_EVENT).option("mode", "DROPMALFORMED").json(path)

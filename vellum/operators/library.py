"""Documents, chunks and collections: listings, scopes, keyed merges and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import text as T
from vellum.operators import prefix

SUMMARY_ROLES = ("document_summary", "page_range_summary")
ROLE_ORDER = {"toc": 0, "abstract": 1, "preface": 2, "introduction": 3, "summary": 4}
ROLE_LIFT = {"toc": -4, "abstract": -3, "preface": -2, "introduction": -1}
NO_PAGE = 9999


# --- listings -----------------------------------------------------------------
def _titled_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks are aggregated per document before the join, so only one row per document moves."""
    per_doc = chunks.groupBy("doc_id").agg(F.min("document_title").alias("_title"),
                                           F.count("chunk_id").alias("chunk_count"))
    return docs.join(per_doc, "doc_id").select(
        "doc_id", F.coalesce("_title", "filename").alias("title"), "filename", "source_type",
        "chunk_count")


def documents_with_counts(docs: DataFrame, chunks: DataFrame,
                          collection_id: str | None = None) -> DataFrame:
    if collection_id is not None:
        chunks = chunks.where(F.col("collection_id") == collection_id)
    return _titled_counts(docs, chunks)


def unassigned_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents none of whose chunks belongs to a collection (one pass over chunks)."""
    per_doc = chunks.groupBy("doc_id").agg(
        F.min("document_title").alias("_title"), F.count("chunk_id").alias("chunk_count"),
        F.count("collection_id").alias("_assigned")).where(
        (F.col("_assigned") == 0) & (F.col("chunk_count") > 0))
    return docs.join(per_doc, "doc_id").select(
        "doc_id", F.coalesce("_title", "filename").alias("title"), "filename", "source_type",
        "chunk_count")


def documents_without_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    per_doc = chunks.groupBy("doc_id").agg(
        F.coalesce(F.min("collection_id"), F.lit("")).alias("collection_id"),
        F.min("document_title").alias("_title"),
        F.count(F.when(F.col("structural_role") == "document_summary", 1)).alias("_summaries"))
    return docs.drop("collection_id").join(per_doc.where("_summaries = 0"), "doc_id").select(
        "doc_id", "filename", "source_type", "collection_id",
        F.coalesce("_title", "filename").alias("document_title"))


def summary_status(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with a display title and whether it already has a summary."""
    have = chunks.where(F.col("structural_role") == "document_summary").select("doc_id").distinct()
    looks_hashed = F.col("filename").rlike("^[0-9a-f]{40,}(\\.|$)")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return (docs.join(have.withColumn("_has", F.lit(True)), "doc_id", "left")
            .select("doc_id", F.when(looks_hashed, stem).otherwise(F.col("filename")).alias("title"),
                    F.col("_has").isNotNull().alias("has_summary")))


def collections_with_counts(collections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Collections, parents before children, with distinct document and chunk counts.

    Counting goes (collection, doc) first and collection second, so a collection
    that owns a third of all chunks is reduced map-side on both steps.
    """
    per_pair = chunks.where(F.col("collection_id").isNotNull()).groupBy(
        "collection_id", "doc_id").agg(F.count("chunk_id").alias("n"))
    per_coll = per_pair.groupBy("collection_id").agg(F.count("doc_id").alias("doc_count"),
                                                     F.sum("n").alias("chunk_count"))
    return collections.join(per_coll, "collection_id", "left").select(
        "collection_id", "name", "parent_id",
        F.coalesce("doc_count", F.lit(0)).cast("bigint").alias("doc_count"),
        F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"))


def parent_first_order() -> list[Column]:
    return [F.coalesce("parent_id", "collection_id"), F.col("parent_id").isNotNull(),
            F.col("collection_id")]


def collection_scopes(collections: DataFrame) -> DataFrame:
    """(scope_id, collection_id): every collection with itself and its direct children."""
    own = collections.select(F.col("collection_id").alias("scope_id"), "collection_id")
    kids = collections.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("scope_id"), "collection_id")
    return own.unionByName(kids).distinct()


# --- reading one document's chunks ---------------------------------------------
def _case(col: Column, ranks: dict[str, int], default: Column) -> Column:
    out = None
    for role, rank in ranks.items():
        out = F.when(col == role, F.lit(rank)) if out is None else out.when(col == role, F.lit(rank))
    return out.otherwise(default)


def reading_order() -> list[Column]:
    page = F.coalesce("page_start", F.lit(NO_PAGE))
    return [_case(F.col("structural_role"), ROLE_ORDER, F.lit(10)), page, F.col("chunk_id")]


def lifted_order() -> list[Column]:
    page = F.coalesce("page_start", F.lit(NO_PAGE))
    return [_case(F.col("structural_role"), ROLE_LIFT, page), F.col("chunk_id")]


def representative_chunks(chunks: DataFrame, max_chars: int = 80000) -> DataFrame:
    """Front matter first, then body by page, cut at a character budget per document."""
    body = chunks.where(F.col("structural_role") != "document_summary").withColumn(
        "text", T.strip(F.col("text"))).where(F.length("text") > 0)
    role = _case(F.col("structural_role"), ROLE_ORDER, F.lit(10))
    page = F.coalesce("page_start", F.lit(NO_PAGE))
    bucket = role.cast("bigint") * 100_000_000 + F.floor(page / 64)
    return prefix.keep_within_budget(body, ["doc_id"], reading_order(), bucket,
                                     F.length("text").cast("bigint"), max_chars)


def chunks_in_page_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    page = F.coalesce("page_start", F.lit(0))
    return chunks.where(~F.col("structural_role").isin(*SUMMARY_ROLES) & page.between(first, last))


def sample_every_nth(chunks: DataFrame, max_chunks: int, order: Sequence[Column], bucket: Column) -> DataFrame:
    """Deterministic even sample: every ``n // max_chunks``-th row of the total order."""
    numbered = prefix.row_numbers(chunks, [], order, bucket, "_rn")
    step = chunks.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / max_chunks)).alias("step"))
    every = (F.col("_rn") - 1) % step.scalar() == 0
    return numbered.where(every & ((F.col("_rn") - 1) / step.scalar() < max_chunks)).drop("_rn")


def sample_texts(chunks: DataFrame, max_chunks: int = 30, strategy: str = "uniform", collection: str | None = None) -> DataFrame:
    """(position, chunk_id, doc_id, text): a repeatable sample of chunk texts in (document, page) order.

    Summaries, contents and empty texts are no candidates; ``collection`` narrows to one collection.  "uniform"
    takes every ``n // max_chunks``-th text, "top_body" the first ones.  Positions come from ranges of
    the order, so no task sees the whole corpus.
    """
    own = chunks.where(~F.col("structural_role").isin("document_summary", "toc") & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    if collection is not None:
        own = own.where(F.col("collection_id") == collection)
    order = [F.col("doc_id"), F.coalesce("page_start", F.lit(0)), F.col("chunk_id")]
    slim = own.select("doc_id", "chunk_id", "page_start", "text")
    if strategy == "top_body":
        first = slim.orderBy(*order).limit(max_chunks)
        return first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select(
            "position", "chunk_id", "doc_id", "text")
    ranked = prefix.ranked(slim, [], order, "_rn")
    step = own.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / max_chunks)).alias("step")).scalar()
    place = (F.col("_rn") - 1) / step
    return ranked.where(((F.col("_rn") - 1) % step == 0) & (place < max_chunks)).select(
        (F.floor(place) + 1).cast("bigint").alias("position"), "chunk_id", "doc_id", "text")


# --- keyed merges ---------------------------------------------------------------
def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace current ones; a missing incoming hash keeps the stored hash."""
    cols = [c for c in current.columns if c != "doc_id"]
    c, i = current.alias("c"), incoming.withColumn("_in", F.lit(True)).alias("i")
    picked = []
    for name in cols:
        new, old = F.col(f"i.{name}"), F.col(f"c.{name}")
        keep = F.coalesce(new, old) if name == "file_hash" else F.when(F.col("i._in"), new).otherwise(old)
        picked.append(keep.alias(name))
    return c.join(i, F.col("c.doc_id") == F.col("i.doc_id"), "full").select(
        F.coalesce("i.doc_id", "c.doc_id").alias("doc_id"), *picked)


def replace_by_key(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every current row whose key arrives again, then append the incoming rows."""
    arriving = incoming.select(*keys).distinct()
    return current.join(arriving, list(keys), "left_anti").unionByName(incoming)


def latest_by_key(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write wins, as an aggregate so hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return best.select(*keys, "_row.*")


def upsert_summary_chunks(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Insert summary chunks; on an id clash only text, title and source_name change."""
    mutable = ("text", "title", "source_name")
    c, s = chunks.alias("c"), summaries.withColumn("_in", F.lit(True)).alias("s")
    out = []
    for name in chunks.columns:
        if name == "chunk_id":
            out.append(F.coalesce("c.chunk_id", "s.chunk_id").alias(name))
        elif name in mutable:
            out.append(F.when(F.col("s._in"), F.col(f"s.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
        else:
            out.append(F.when(F.col("c.chunk_id").isNotNull(), F.col(f"c.{name}"))
                       .otherwise(F.col(f"s.{name}")).alias(name))
    return c.join(s, F.col("c.chunk_id") == F.col("s.chunk_id"), "full").select(*out)


def with_provenance(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Fill collection, source name, title and path from the item, then the document."""
    meta = F.col("d.metadata_json")

    def field(name: str) -> Column:
        return F.get_json_object(meta, f"$.{name}")

    joined = items.alias("i").join(docs.alias("d"), F.col("i.doc_id") == F.col("d.doc_id"), "left")
    source = T.first_present(F.col("i.source_name"), field("source_name"), F.col("d.filename"))
    return joined.select(
        "i.chunk_id", "i.doc_id",
        T.first_present(F.col("i.collection_id"), field("collection_id")).alias("collection_id"),
        source.alias("source_name"),
        T.first_present(F.col("i.document_title"), field("title"), field("document_title"), source)
        .alias("document_title"),
        F.coalesce("i.source_type", "d.source_type", F.lit("pdf_book")).alias("source_type"))


def delete_documents(docs: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = doomed.select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def delete_collection(collections: DataFrame, chunks: DataFrame, collection_id: str,
                      clear_chunks: bool = True) -> tuple[DataFrame, DataFrame]:
    gone = F.col("collection_id") == collection_id
    left = collections.where(~gone).withColumn(
        "parent_id", F.when(F.col("parent_id") == collection_id, None).otherwise(F.col("parent_id")))
    if clear_chunks:
        chunks = chunks.withColumn("collection_id", F.when(gone, None).otherwise(F.col("collection_id")))
    return left, chunks


def assign_to_collection(chunks: DataFrame, collection_id: str, doc_ids: Sequence[str] = (),
                         source_type: str | None = None) -> DataFrame:
    """Move chunks by document and, independently, every chunk of a source type."""
    if not doc_ids and not source_type:
        raise ValueError("give doc_ids or source_type")
    hit = F.lit(False)
    if doc_ids:
        hit = hit | F.col("doc_id").isin(*doc_ids)
    if source_type:
        hit = hit | (F.col("source_type") == source_type)
    return chunks.withColumn("collection_id", F.when(hit, F.lit(collection_id))
                             .otherwise(F.col("collection_id")))


def unassign(chunks: DataFrame, doc_ids: Sequence[str]) -> DataFrame:
    return chunks.withColumn("collection_id", F.when(F.col("doc_id").isin(*doc_ids), None)
                             .otherwise(F.col("collection_id")))


def create_collection(collections: DataFrame, collection_id: str, name: str, description: str = "",
                      parent_id: str | None = None) -> DataFrame:
    """Append a collection; the id must be new and the parent, if any, must exist."""
    found = {r[0] for r in collections.where(F.col("collection_id").isin(
        *[i for i in (collection_id, parent_id) if i])).select("collection_id").collect()}
    if collection_id in found:
        raise ValueError(f"collection exists: {collection_id}")
    if parent_id and parent_id not in found:
        raise ValueError(f"no such parent: {parent_id}")
    row = collections.sparkSession.range(1).select(
        F.lit(collection_id).alias("collection_id"), F.lit(name).alias("name"),
        F.lit(description).alias("description"), F.lit(parent_id).cast("string").alias("parent_id"),
        F.current_timestamp().alias("created_at"))
    return collections.unionByName(row.select(*collections.columns), allowMissingColumns=True)


def stale_documents(docs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored documents whose path arrives again under a different content id."""
    fresh = incoming.select("source_path", F.col("doc_id").alias("new_id")).distinct()
    return docs.join(fresh, "source_path").where(F.col("doc_id") != F.col("new_id")).select(
        docs.columns).distinct()


def changed_sources(incoming: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources whose (id, content hash) is not stored yet."""
    hashed = incoming.withColumn("file_hash", F.sha2(F.col("text"), 256))
    return hashed.join(docs.select("doc_id", "file_hash").distinct(), ["doc_id", "file_hash"], "left_anti")


# --- corpus health ---------------------------------------------------------------
def distribution(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, min, quartiles, p95, max, mean and population deviation."""
    v = F.col(value).cast("double")

    def pct(p: float) -> Column:
        return F.round(F.percentile(v, F.lit(p)), 4)

    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min_value"), pct(0.25).alias("p25"),
        pct(0.5).alias("median_value"), F.round(F.avg(v), 4).alias("mean_value"),
        pct(0.75).alias("p75"), pct(0.95).alias("p95"), F.max(v).alias("max_value"),
        F.round(F.stddev_pop(v), 4).alias("stdev_pop"))

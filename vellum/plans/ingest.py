"""Raw text to embedded chunks, each stage a DataFrame a job may persist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from vellum.functions import cleaning, embedder
from vellum.operators import chunking, library, structure
from vellum.sources import sinks


@dataclass(frozen=True)
class Ingested:
    sections: DataFrame
    chunks: DataFrame


def prepare(docs: DataFrame, max_tokens: int = chunking.P["max_tokens"]) -> Ingested:
    """Clean, parse, label, chunk and merge documents (doc_id, text)."""
    md = docs.select("doc_id", cleaning.clean_markdown(F.col("text")).alias("text"))
    secs = structure.enrich(structure.with_fallback_section(md, structure.sections(md)))
    chunks = chunking.merge_small(chunking.chunk_sections(secs, max_tokens))
    return Ingested(secs, chunks)


def embed(chunks: DataFrame, dimension: int = 256) -> DataFrame:
    return chunks.withColumn("embedding", embedder.hash_embedding(F.col("text"), dimension))


def run(docs: DataFrame, stored: DataFrame | None, out: str) -> DataFrame:
    """Ingest what changed and write sections and chunks under ``out``; returns the chunk table read back.

    Written tables cut the lineage between stages and survive lost executors.
    """
    fresh = docs if stored is None else library.changed_sources(docs, stored)
    work = prepare(fresh.select("doc_id", "text"))
    sinks.write_artifact(work.sections, f"{out}/sections")
    sinks.write_artifact(embed(work.chunks), f"{out}/chunks")
    return docs.sparkSession.read.parquet(f"{out}/chunks")

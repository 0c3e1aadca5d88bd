"""Ingest: chunk documents, audit outcomes, replace chunks, summarize."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.chunk_stream import BLOCK, block_sentences, chunk_sentences
from quirefold.operators.chunking import chunk_documents
from quirefold.operators.layout import page_stream
from quirefold.session import small_side


def replace_document_chunks(existing: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Re-ingest: old chunks of every incoming document go, the new ones come.

    Only the incoming ids meet the old table; while they are few it is not shuffled.
    """
    kept = existing.join(small_side(incoming.select(key).distinct()), key, "left_anti")
    return kept.unionByName(incoming)


def ingest_audit(docs: DataFrame, chunks: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per document: status, chunks created, message, progress.

    ``checks`` maps a message to the condition that fails a document; the first that holds
    is kept. A document without any chunk still completes.
    """
    error = F.coalesce(*[F.when(bad, message) for message, bad in checks.items()], F.lit(None).cast("string"))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    joined = docs.select("doc_id", error.alias("error")).join(counts, "doc_id", "left")
    failed = F.col("error").isNotNull()
    return joined.select(
        "doc_id",
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("chunks_created"),
        F.coalesce("error", F.lit("")).alias("error_message"),
        F.when(failed, 10).otherwise(100).alias("progress"),
    )


def ingest_pages(docs: DataFrame, blocks: DataFrame, cells: DataFrame, checks: dict[str, Column], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Chunks of all pages, and the audit of all documents.

    ``docs``: the manifest, doc_id and what the ``checks`` read. A document that fails one of them has no chunk and its message in the audit; the
    others go on. Tables and text of a page make one stream (see page_stream), which is cut in blocks of sentences, so no
    task holds a document.
    """
    failed = F.coalesce(*[F.when(bad, True) for bad in checks.values()], F.lit(False))
    sound = docs.where(~failed).select("doc_id")
    stream = page_stream(blocks.join(small_side(sound), "doc_id", "left_semi"), cells.join(small_side(sound), "doc_id", "left_semi"))
    chunks = chunk_sentences(block_sentences(stream, "page_number", "kind", "no"), block=block)
    return chunks, ingest_audit(docs, chunks, checks)


def ingest_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("chunks_created").alias("n_chunks"))


def document_chunks(chunks: DataFrame, doc_id) -> DataFrame:
    """Chunks of one document in order."""
    return chunks.filter(F.col("doc_id") == doc_id).orderBy("page_number", "chunk_index")


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def bulk_ingest(manifest_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of all new documents at once, and chunks and pages per document."""
    chunks = chunk_documents(manifest_docs)
    summary = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("page_number").alias("n_pages")
    )
    return chunks, summary

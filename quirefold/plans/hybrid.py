"""Hybrid retrieval for a whole table of questions as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.operators.dense import dense_topk
from quirefold.operators.fusion import candidate_pool, confidence_gate, rerank, rrf_fuse
from quirefold.operators.lexical import bm25_topk, corpus_counts
from quirefold.operators.store import embedded, narrowed
from quirefold.session import small_side, written


@dataclass
class Retrieval:
    dense: DataFrame
    lexical: DataFrame
    fused: DataFrame
    hits: DataFrame
    gate: DataFrame


def hybrid_retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    depth: int = fv.DEPTH,
    k: int = fv.FINAL_K,
    threshold: float = fv.CONFIDENCE_THRESHOLD,
    document_filter: DataFrame | None = None,
    notes: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> Retrieval:
    """Dense and BM25 lists, fused, reranked and gated.

    ``queries``: query_id, text. ``corpus``: chunk_id, text, and doc_id where a filter or notes are given; or a store, whose
    ``counts`` may be at hand. Of texts the store is written first, so that they are read once.
    ``document_filter`` (doc_id) narrows the corpus below every search. With a query_id beside the doc_id it narrows single
    queries: those it lists see their documents only, the others see all.
    ``notes`` (chunk_id, doc_id, text) are searched beside the corpus; a chunk id that both hold counts once, as the corpus has it.
    """
    if notes is not None:
        cols = ["chunk_id", "doc_id", "text"]
        corpus = candidate_pool(corpus.select(*cols), notes.select(*cols))
    scoped = None
    if document_filter is not None and "query_id" in document_filter.columns:
        scoped = document_filter.select("query_id", "doc_id").distinct()
    elif document_filter is not None:
        corpus = corpus.join(small_side(document_filter.select("doc_id").distinct()), "doc_id", "left_semi")
    if "terms" not in corpus.columns or "embedding" not in corpus.columns:
        corpus = written(narrowed(corpus))
    if scoped is None:
        dense = dense_topk(embedded(queries), corpus, depth)
        lexical = bm25_topk(queries, corpus, depth, counts=counts)
    else:
        free = queries.join(scoped.select("query_id").distinct(), "query_id", "left_anti")
        asked = embedded(queries)
        dense = dense_topk(embedded(free), corpus, depth).unionByName(dense_topk(asked, corpus, depth, allow=scoped))
        counts = corpus_counts(corpus) if counts is None else counts
        lexical = bm25_topk(free, corpus, depth, counts=counts).unionByName(bm25_topk(queries, corpus, depth, allow=scoped, counts=counts))
    fused = rrf_fuse(dense, lexical)
    hits = rerank(fused, queries, corpus, k, per_query=2 * depth)
    return Retrieval(dense, lexical, fused, hits, confidence_gate(hits, queries, threshold))

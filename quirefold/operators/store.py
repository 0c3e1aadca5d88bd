"""The narrow form of a corpus that every search reads in place of its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import bm25_tokens, let
from quirefold.functions.vectors import hash_embed


def term_counts(tokens: Column) -> Column:
    """Tokens as a sorted array of (term, tf): equal ones stand together once sorted, so a row costs its sort and nothing is shuffled."""

    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def counted(s: Column) -> Column:
        def runs(at: Column) -> Column:
            return F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf")))

        return let(starts(s), runs)

    kept = let(F.sort_array(tokens), counted)
    return F.when(F.size(tokens) > 0, kept).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def termed(corpus: DataFrame) -> DataFrame:
    """chunk_id, doc_id (where there is one), length in tokens and (term, tf) array; a store is taken as it is.

    A null text counts as an empty one.
    """
    if "terms" in corpus.columns:
        return corpus
    ids = [c for c in ("chunk_id", "doc_id") if c in corpus.columns]
    split = corpus.select(*ids, bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return split.select(*ids, F.size("tokens").alias("length"), term_counts(F.col("tokens")).alias("terms"))


def embedded(df: DataFrame) -> DataFrame:
    """``df`` with an embedding column; precomputed vectors are used as they are."""
    return df if "embedding" in df.columns else df.withColumn("embedding", hash_embed(F.col("text")))


def narrowed(corpus: DataFrame) -> DataFrame:
    """chunk_id, doc_id, length, terms, embedding: all that searching and reranking read, in one pass over the texts."""
    if "terms" in corpus.columns and "embedding" in corpus.columns:
        return corpus
    ids = [c for c in ("chunk_id", "doc_id") if c in corpus.columns]
    with_vector = embedded(corpus).select(*ids, "text", "embedding")
    split = with_vector.select(*ids, bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), "embedding")
    return split.select(*ids, F.size("tokens").alias("length"), term_counts(F.col("tokens")).alias("terms"), "embedding")

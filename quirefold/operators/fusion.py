"""Rank fusion, rerank, confidence gate and retrieval report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import bm25_tokens
from quirefold.session import BROADCAST_ROWS, small_side


def candidate_pool(*arms: DataFrame) -> DataFrame:
    """Union of candidate arms, one row per chunk; on a repeat the earlier arm wins.

    Chunks are unique inside an arm. Later arms lose the ids of earlier ones, and only ids
    are sent for that: put the short arm (dense hits) first.
    """
    pool, ids = arms[0], arms[0].select("chunk_id")
    for arm in arms[1:]:
        fresh = arm.join(small_side(ids), "chunk_id", "left_anti")
        pool = pool.unionByName(fresh)
        ids = ids.unionByName(fresh.select("chunk_id"))
    return pool


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int = fv.RRF_K) -> DataFrame:
    """Full outer merge of two ranked lists; a missing rank adds nothing and reads 999."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = lexical.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    both = d.join(b, ["query_id", "chunk_id"], "full_outer")

    def share(rank: str) -> Column:
        return F.coalesce(1 / (F.lit(k) + F.col(rank)), F.lit(0.0))

    return both.select(
        "query_id",
        "chunk_id",
        F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"),
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        F.coalesce("dense_rank", F.lit(fv.MISSING_RANK)).alias("dense_rank"),
        F.coalesce("bm25_rank", F.lit(fv.MISSING_RANK)).alias("bm25_rank"),
        (share("dense_rank") + share("bm25_rank")).alias("rrf_score"),
    )


def rrf_fuse_many(lists: list[DataFrame], k: int = fv.RRF_K) -> DataFrame:
    """Fusion of any number of ranked lists (query_id, chunk_id, rank)."""
    pool = None
    for ranked in lists:
        part = ranked.select("query_id", "chunk_id", (1 / (F.lit(k) + F.col("rank"))).alias("part"))
        pool = part if pool is None else pool.unionByName(part)
    return pool.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("rrf_score"))


def content_tokens(text: Column) -> Column:
    """Distinct query tokens without stop words; all of them when nothing else is left."""
    every = F.array_distinct(bm25_tokens(text))
    kept = F.array_except(every, F.array(*[F.lit(w) for w in fv.RERANK_STOP_WORDS]))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = fv.FINAL_K,
           per_query: int = 2 * fv.DEPTH) -> DataFrame:
    """Final k per query from fused candidates, by dense, lexical and overlap evidence.

    Candidates are at most ``per_query`` rows for each query. Where the count of queries
    makes that small their ids and scores are broadcast to the corpus (query words join the matches), so chunk texts stay where they are
    and only matched chunks are tokenized, or have their terms read where ``corpus`` is a store.
    """
    q = queries.select("query_id", content_tokens(F.col("text")).alias("q_tokens"))
    asked = candidates
    most = BROADCAST_ROWS // per_query
    if queries.limit(most + 1).count() <= most:
        asked = F.broadcast(asked)
    own = F.transform("terms", lambda t: t["term"]) if "terms" in corpus.columns else bm25_tokens(F.col("text"))
    c = corpus.select("chunk_id", "terms" if "terms" in corpus.columns else "text").join(asked, "chunk_id").join(q, "query_id")
    shared = F.size(F.array_intersect("q_tokens", own))
    ratio = shared / F.greatest(F.lit(1), F.size("q_tokens"))
    c = c.select(*candidates.columns, ratio.alias("ratio"))
    lexical = F.when(F.col("bm25_score") > 0, F.least(F.lit(0.85), F.col("bm25_score") / 6)).otherwise(0.0)
    base = F.greatest(F.col("dense_score"), lexical)
    blended = base * 0.5 + F.least(F.lit(1.0), F.col("ratio")) * 0.5
    score = (
        F.when((F.col("ratio") > 0) & (base > 0), blended)
        .when(F.col("ratio") > 0, F.least(F.lit(0.95), F.col("ratio")))
        .otherwise(F.col("dense_score") * 0.25)
    )
    c = c.withColumn("rerank_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rerank_score"), F.desc(F.round("rrf_score", 9)), "dense_rank", "bm25_rank", "chunk_id"
    )
    ranked = c.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        "query_id", "chunk_id", "rank", "rerank_score",
        F.round("dense_score", 4).alias("dense_score"),
        F.round("bm25_score", 4).alias("bm25_score"),
        F.round("rrf_score", 6).alias("rrf_score"),
    )


def confidence_gate(hits: DataFrame, queries: DataFrame, threshold: float = fv.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Best score per query, zero without hits, and whether it passes."""
    best = hits.groupBy("query_id").agg(F.max("rerank_score").alias("best"), F.count(F.lit(1)).alias("n_hits"))
    joined = queries.select("query_id").join(best, "query_id", "left")
    score = F.coalesce("best", F.lit(0.0))
    return joined.select(
        "query_id", score.alias("best_score"), ((score >= threshold) & F.col("n_hits").isNotNull()).alias("passed")
    )


def retrieval_report(dense: DataFrame, lexical: DataFrame, gate: DataFrame) -> DataFrame:
    """Candidate counts per query beside the gate's verdict."""
    tagged = dense.select("query_id", "chunk_id", F.lit(1).alias("d"), F.lit(0).alias("b")).unionByName(
        lexical.select("query_id", "chunk_id", F.lit(0).alias("d"), F.lit(1).alias("b"))
    )
    merged = tagged.groupBy("query_id", "chunk_id").agg(F.max("d").alias("d"), F.max("b").alias("b"))
    counts = merged.groupBy("query_id").agg(
        F.sum("d").alias("n_dense"), F.sum("b").alias("n_bm25"), F.count(F.lit(1)).alias("n_fused")
    )
    joined = gate.join(counts, "query_id", "left")
    return joined.select(
        "query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_dense", "n_bm25", "n_fused")], "best_score", "passed"
    )

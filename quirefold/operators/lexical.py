"""Lexical retrieval: corpus statistics, BM25 and token overlap, over texts or a corpus store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import bm25_tokens
from quirefold.operators.store import termed
from quirefold.operators.topk import MAX_QUERIES, MAX_SCOPED, SCORES_AT_ONCE, BestItems, best_of, best_rows, filled, sees, with_lists
from quirefold.session import small_side, tidy, written


def postings(corpus: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) for every chunk; counted inside the row, nothing is shuffled."""
    return termed(corpus).select("chunk_id", F.inline("terms")).select("chunk_id", "term", F.col("tf").cast("long").alias("tf"))


# A separator, so no token holds it: marks the rows that count chunks by length.
LENGTH_MARK = "\x1f"


def counted(corpus: DataFrame) -> DataFrame:
    """(term, n) as :func:`corpus_counts` tells it, not yet written."""
    terms = F.transform("terms", lambda t: t["term"])
    rows = termed(corpus).select(F.explode(F.concat(terms, F.array(F.concat(F.lit(LENGTH_MARK), F.col("length"))))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """(term, n): chunks holding each term and, under a mark, chunks of each length.

    One pass gives everything BM25 needs to know of the corpus. Terms are distinct
    inside their row and counted map-side first, so a stop word costs one partial count per
    task. The table is the size of the vocabulary; it is written once because the mean idf,
    the mean length and the query join all read it.
    """
    return written(counted(corpus))


def changed_counts(counts: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """``counts`` after the chunks ``gone`` left the corpus and ``come`` joined it; only these two are read."""
    less = counted(gone).select("term", (-F.col("n")).alias("n"))
    return counts.unionByName(less).unionByName(counted(come)).groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")


def corpus_size(counts: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length in tokens."""
    length = F.substring("term", 2, 20).cast("long")
    return counts.filter(F.col("term").startswith(LENGTH_MARK)).agg(
        F.sum("n").alias("n_chunks"), (F.sum(length * F.col("n")) / F.sum("n")).alias("avg_len")
    )


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, df, idf) over the whole vocabulary; a negative idf becomes a quarter of the mean idf."""
    n = corpus_size(counts).select("n_chunks").scalar()
    terms = counts.filter(~F.col("term").startswith(LENGTH_MARK)).withColumnRenamed("n", "df")
    raw = terms.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    idf = F.when(F.col("raw") < 0, mean * fv.BM25_EPSILON).otherwise(F.col("raw"))
    return raw.select("term", "df", idf.alias("idf"))


def query_terms(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """Queries with the known terms of each as an array of (term, qtf, idf).

    Only this query-sized table meets the vocabulary; terms the corpus lacks score nothing.
    """
    terms = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term"))
    counted = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = counted.join(stats.select("term", "idf"), "term")
    return weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "qtf", "idf")).alias("terms"))


MAX_TERMS = 500_000
ROWS_AT_ONCE = 1024
MATCHES_AT_ONCE = 500_000  # of a query and a chunk in a term: some 30 MB with what is made of them


def bm25_weight(tf: Column | np.ndarray, length: Column | np.ndarray, avg_len: float):
    """What one term of a chunk weighs before its idf."""
    return tf * (fv.BM25_K1 + 1) / (tf + fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * length / avg_len))


class QueryTerms:
    """Some queries' weighted terms as sparse rows by term: what a task holds to score chunks.

    ``queries``: query_id and an array ``terms`` of structs with term, weight.
    """

    def __init__(self, queries: pd.DataFrame):
        self.ids = queries["query_id"].to_numpy()
        rows = [(t["term"], q, float(t["weight"])) for q, terms in enumerate(queries["terms"]) for t in terms]
        names = sorted({r[0] for r in rows})
        number = {t: i for i, t in enumerate(names)}
        self.terms = pa.array(names, pa.string())
        no = np.array([number[r[0]] for r in rows], np.int64)
        order = np.argsort(no, kind="stable")
        self.query = np.array([r[1] for r in rows], np.int64)[order]
        self.weight = np.array([r[2] for r in rows], np.float64)[order]
        self.first = np.searchsorted(no[order], np.arange(len(names) + 1))


def spread_out(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then the same for every other entry."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def matches(asked: QueryTerms, batch: pa.RecordBatch, weigh) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(part of the batch, query, row of the part, contribution) of every term that a chunk shares with a query.

    A part has at most ``MATCHES_AT_ONCE`` matches or one row, and scores of all its rows and queries stay below ``SCORES_AT_ONCE``: common words
    match most pairs, so rows alone bound nothing.
    """
    step = max(1, min(ROWS_AT_ONCE, SCORES_AT_ONCE // max(1, len(asked.ids))))
    for lo in range(0, batch.num_rows, step):
        rows = batch.slice(lo, step)
        chunk, own, first, count = _met(asked, rows.column("terms"), term_lengths(rows), weigh)
        total = np.concatenate(([0], np.cumsum(np.bincount(chunk, weights=count, minlength=rows.num_rows))))
        a = 0
        while a < rows.num_rows:
            b = max(int(np.searchsorted(total, total[a] + MATCHES_AT_ONCE, "right")) - 1, a + 1)
            i, j = np.searchsorted(chunk, (a, b))
            at = spread_out(first[i:j], count[i:j])
            yield rows.slice(a, b - a), asked.query[at], np.repeat(chunk[i:j] - a, count[i:j]), asked.weight[at] * np.repeat(own[i:j], count[i:j])
            a = b


def _met(asked: QueryTerms, terms: pa.ListArray, lengths: np.ndarray, weigh) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, weight, first entry, entries) of every term of a chunk that queries ask for."""
    flat = terms.flatten()
    no = pc.index_in(flat.field("term"), value_set=asked.terms)
    known = no.is_valid().to_numpy(zero_copy_only=False)
    no = no.fill_null(0).to_numpy(zero_copy_only=False)[known]
    chunk = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[known]
    tf = flat.field("tf").to_numpy(zero_copy_only=False)[known].astype(np.float64)
    own = weigh(tf, lengths[chunk])
    return chunk, own, asked.first[no], asked.first[no + 1] - asked.first[no]


def term_lengths(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("length").to_numpy(zero_copy_only=False).astype(np.float64)


def _scan(asked: QueryTerms, weigh, decimals: int, k: int, own: np.ndarray | None = None):
    """The k best rows of each query in a task; with ``own``, the queries' numbers in ``seen_by``, among the rows they see and down to a score of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kinds = BestItems(len(asked.ids), k), None
        for whole in batches:
            for batch, q, d, x in matches(asked, whole, weigh):
                n = batch.num_rows
                scores = np.bincount(q * n + d, weights=x, minlength=len(asked.ids) * n).astype(np.float64).reshape(-1, n).round(decimals)  # integers without a match
                if own is None:
                    scores[scores <= 0] = -np.inf
                else:
                    scores = np.where(sees(batch, own), np.maximum(scores, 0), -np.inf)
                best.add(scores, batch.column("chunk_id").to_numpy(zero_copy_only=False))
                kinds = batch.schema.field("chunk_id").type
        if kinds is not None:
            rows = best.rows(asked.ids)
            if len(rows):
                yield best_rows(rows, kinds)

    return tidy(run)


def slices(queries: DataFrame, most: int = MAX_QUERIES) -> Iterator[QueryTerms]:
    """The queries in slices that a task can hold: at most about ``most`` of them with ``MAX_TERMS`` terms, whatever their number."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("t")).first()
    n = max(1, -(-size.n // most), -(-(size.t or 0) // MAX_TERMS))
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        yield QueryTerms(part.toPandas())


def score_schema(queries: DataFrame, corpus: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(corpus.dtypes)['chunk_id']}, score double"


def scan_topk(queries: DataFrame, corpus: DataFrame, weigh, decimals: int, k: int) -> DataFrame:
    """Top-k of positive scores, exact: one pass over the store for each slice of queries, k rows per query and task leave it."""
    slim, found = corpus.select("chunk_id", "length", "terms"), None
    for asked in slices(queries):
        part = slim.mapInArrow(_scan(asked, weigh, decimals, k), score_schema(queries, corpus))
        found = part if found is None else found.unionByName(part)
    return best_of(found, k)


DECIMALS = 10  # sums of equal terms in another order still tie


def bm25_weights(known: DataFrame) -> DataFrame:
    return known.select("query_id", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["qtf"] * t["idf"]).alias("weight"))).alias("terms"))


def _one(tf, length):
    return np.ones_like(tf)


def bm25_within(queries: DataFrame, corpus: DataFrame, allow: DataFrame, known: DataFrame, avg_len: float, k: int) -> DataFrame:
    """Top-k by BM25 among the documents that ``allow`` (query_id, doc_id) lists for a query.

    One pass over the chunks that any query of a slice sees: each has the numbers of its queries and is scored against their
    terms, and a task keeps k rows per query. Lists stay in the engine, whatever their length. A query all of whose scores are
    zero or less counts shared terms instead.
    """
    once = written(corpus.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"))
    if not once.isEmpty():  # the copies of a repeated id are one chunk
        copies = _joined_within(queries, corpus.join(small_side(once), "chunk_id", "left_semi"), allow, known, avg_len)
        corpus = corpus.join(small_side(once), "chunk_id", "left_anti")
    else:
        copies = None
    listed = allow.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_semi")
    asked = written(listed.join(known, "query_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast(known.schema["terms"].dataType))))
    hits = _scan_within(bm25_weights(asked), corpus, allow, lambda tf, length: bm25_weight(tf, length, avg_len), DECIMALS, k)
    if copies is not None:
        hits = hits.unionByName(copies.select("query_id", "chunk_id", F.greatest(F.coalesce("bm25", F.lit(0.0)), F.lit(0.0)).alias("score")))
    floor = known.select(F.min(F.array_min(F.transform("terms", lambda t: t["idf"])))).first()[0]
    if floor is None or floor > 0:
        return best_of(hits, k)
    hits = written(hits)
    missed = written(hits.groupBy("query_id").agg(F.max("score").alias("best")).where("best <= 0").select("query_id"))
    again = _scan_within(_ones(asked.join(missed, "query_id", "left_semi")), corpus, allow, _one, 0, k)
    if copies is not None:
        again = again.unionByName(copies.join(missed, "query_id", "left_semi").select("query_id", "chunk_id", F.coalesce("shared", F.lit(0.0)).alias("score")))
    return best_of(hits.join(missed, "query_id", "left_anti").unionByName(again), k)


def _scan_within(asked: DataFrame, corpus: DataFrame, allow: DataFrame, weigh, decimals: int, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best of each query and task among what ``allow`` lists, zeros too."""
    slim, found = corpus.select("chunk_id", "doc_id", "length", "terms"), None
    for part in slices(asked, MAX_SCOPED):
        seen, own = with_lists(slim, allow, part.ids, dict(asked.dtypes)["query_id"])
        rows = seen.mapInArrow(_scan(part, weigh, decimals, k, own), score_schema(asked, corpus))
        found = rows if found is None else found.unionByName(rows)
    return found


def _joined_within(queries: DataFrame, corpus: DataFrame, allow: DataFrame, known: DataFrame, avg_len: float) -> DataFrame:
    """(query_id, chunk_id, bm25, shared) of all chunks that a query sees, a row for each copy; null where nothing is shared."""
    pairs = allow.select("query_id", "doc_id").distinct().join(queries.select("query_id"), "query_id", "left_semi")
    asked = pairs.join(known.select("query_id", F.inline("terms")), "query_id")
    chunks = corpus.join(small_side(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    met = chunks.select("chunk_id", "doc_id", "length", F.inline("terms")).join(small_side(asked), ["doc_id", "term"])
    weight = F.col("qtf") * F.col("idf") * bm25_weight(F.col("tf"), F.col("length"), avg_len)
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), DECIMALS).alias("bm25"), F.count(F.lit(1)).cast("double").alias("shared"))
    every = chunks.select("chunk_id", "doc_id").join(small_side(pairs), "doc_id").select("query_id", "chunk_id")
    return every.join(scored, ["query_id", "chunk_id"], "left")


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = fv.DEPTH, allow: DataFrame | None = None,
              counts: DataFrame | None = None) -> DataFrame:
    """Top-k chunks per query by BM25; a query whose best score is not positive falls back to overlap.

    Lists short of k are filled with chunks of score zero, by id. ``allow`` (query_id, doc_id) restricts queries to listed documents, and a
    query without a row in it finds nothing; term statistics are always those of the whole corpus.
    ``corpus``: texts, or a store (:mod:`quirefold.operators.store`); of texts the narrow form is written once and read by every step.
    ``counts``: the corpus' :func:`corpus_counts`, where they are at hand.
    """
    if "terms" not in corpus.columns:
        corpus = written(termed(corpus))
    counts = corpus_counts(corpus) if counts is None else counts
    stats = term_stats(counts)
    avg_len = corpus_size(counts).first()["avg_len"] or 1.0
    known = written(query_terms(queries, stats))
    if allow is not None:
        return bm25_within(queries, corpus, allow, known, avg_len, k)
    hits = scan_topk(bm25_weights(known), corpus, lambda tf, length: bm25_weight(tf, length, avg_len), DECIMALS, k)
    floor = known.select(F.min(F.array_min(F.transform("terms", lambda t: t["idf"])))).first()[0]
    if floor is None or floor > 0:
        # every shared term adds a positive amount, so no query needs the fallback
        return filled(hits, queries, corpus, k)
    hits = written(hits)
    missed = known.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    if not missed.isEmpty():
        hits = hits.unionByName(scan_topk(_ones(missed), corpus, _one, 0, k))
    return filled(hits, queries, corpus, k)


def _ones(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), F.lit(1.0).alias("weight"))).alias("terms"))


def overlap_topk(queries: DataFrame, corpus: DataFrame, k: int = fv.DEPTH) -> DataFrame:
    """Top-k chunks per query by the number of distinct shared tokens; short lists are filled by id."""
    own = queries.select("query_id", F.array_distinct(bm25_tokens(F.col("text"))).alias("t"))
    asked = own.select("query_id", F.transform("t", lambda t: F.struct(t.alias("term"))).alias("terms"))
    slim = termed(corpus)
    return filled(scan_topk(_ones(asked), slim, _one, 0, k), queries, corpus, k)

"""Exact top-k of a table of queries over a corpus.

The corpus is scanned in Arrow batches, each scored against all queries at once as a
matrix; a task keeps only its k best per query, and a window over those few rows picks
the final k. Corpus rows are not shuffled.

Queries ride along with the scan only while they fit a checked bound. Beyond it, both
sides are laid on a grid of hash cells (a fragment-and-replicate theta join): every
query meets every corpus row in exactly one cell, and a cell's size is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import tidy

MAX_QUERIES = 4096
CELL_ROWS = 20_000
SCORES_AT_ONCE = 500_000  # scores a task holds at once: 4 MB, and as much for each step of their making
MAX_SCOPED = 1024


class Scorer(Protocol):
    decimals: int
    positive_only: bool

    def prepare(self, queries: pd.DataFrame) -> object: ...

    def score(self, prepared: object, corpus: pd.DataFrame) -> np.ndarray:
        """Scores, one row per query and one column per corpus row; -inf drops a pair."""


class BestItems:
    """The k best items per query seen so far; ties go to the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * n_queries
        self.ids = [np.empty(0, dtype=object)] * n_queries
        self.floor = np.full(n_queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hopeful = (scores >= self.floor[:, None]) & (scores > -np.inf)
        for q in np.flatnonzero(hopeful.any(axis=1)):
            at = np.flatnonzero(hopeful[q])
            s = np.concatenate([self.scores[q], scores[q, at]])
            i = np.concatenate([self.ids[q], ids[at]])
            if len(s) > self.k:
                kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
                keep = s >= kth
                s, i = s[keep], i[keep]
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]
            if len(order) == self.k:
                self.floor[q] = s[order[-1]]

    def rows(self, query_ids: np.ndarray) -> pd.DataFrame:
        counts = [len(s) for s in self.scores]
        return pd.DataFrame(
            {
                "query_id": np.repeat(query_ids, counts),
                "chunk_id": np.concatenate(self.ids) if self.ids else np.empty(0, dtype=object),
                "score": np.concatenate(self.scores) if self.scores else np.empty(0),
            }
        )


def _search(scorer: Scorer, queries: pd.DataFrame, batches, k: int) -> pd.DataFrame:
    prepared = scorer.prepare(queries)
    best = BestItems(len(queries), k)
    step = max(1, SCORES_AT_ONCE // max(1, len(queries)))
    for batch in batches:
        for lo in range(0, len(batch), step):
            part = batch.iloc[lo : lo + step] if isinstance(batch, pd.DataFrame) else batch.slice(lo, step).to_pandas()
            scores = np.round(scorer.score(prepared, part), scorer.decimals)
            if scorer.positive_only:
                scores[scores <= 0] = -np.inf
            best.add(scores, part["chunk_id"].to_numpy())
    return best.rows(queries["query_id"].to_numpy())


def best_rows(rows: pd.DataFrame, item: pa.DataType) -> pa.RecordBatch:
    """What :meth:`BestItems.rows` gives as a batch whose ids have the type ``item``."""
    return pa.RecordBatch.from_arrays([pa.array(rows["query_id"]), pa.array(rows["chunk_id"], item), pa.array(rows["score"])], names=["query_id", "chunk_id", "score"])


def with_lists(corpus: DataFrame, allow: DataFrame, ids: np.ndarray, kind: str) -> tuple[DataFrame, np.ndarray]:
    """The rows of ``corpus`` that ``allow`` (query_id, doc_id) lists for any of the queries ``ids``, and the number of each query.

    A row has the numbers of the queries that see it as an array ``seen_by``. A document's list is gathered before it meets the corpus, map-side first, so
    that what is shuffled is a corpus row and a few bytes for each pair; the slice's own ids, ``MAX_SCOPED`` at most, are broadcast.
    """
    known, own = np.unique(ids, return_inverse=True)
    names = corpus.sparkSession.createDataFrame(pd.DataFrame({"query_id": known, "no": np.arange(len(known), dtype=np.int32)}), f"query_id {kind}, no int")
    lists = allow.select("query_id", "doc_id").join(F.broadcast(names), "query_id").groupBy("doc_id").agg(F.collect_set("no").alias("seen_by"))
    return corpus.join(lists, "doc_id").drop("doc_id"), own


def sees(batch: pa.RecordBatch, own: np.ndarray) -> np.ndarray:
    """Which query (row) sees which row of the batch (column)."""
    lists, n = batch.column("seen_by"), batch.num_rows
    marks = np.zeros((int(own.max()) + 1 if len(own) else 0, n), bool)
    marks[lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))] = True
    return marks[own]


def best_of(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, chunk_id, score) of each query with their rank; ties go to the smaller id. Tasks cut to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def filled(hits: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``hits`` with every query's list brought up to k rows by score zero, smaller ids first.

    A list short of k hits lacks fewer than k rows, so the k smallest ids of the corpus hold
    enough that are not hits, and the corpus is not searched again.
    """
    ids = [r[0] for r in corpus.select("chunk_id").orderBy("chunk_id").limit(k).collect()]
    if not ids:
        return hits
    short = queries.select("query_id").join(hits.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    spare = short.select("query_id", F.explode(F.array(*[F.lit(i) for i in ids])).alias("chunk_id"))
    spare = spare.select("query_id", F.col("chunk_id").cast(hits.schema["chunk_id"].dataType).alias("chunk_id"))
    spare = spare.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return best_of(hits.drop("rank").unionByName(spare), k)


def topk_join(queries: DataFrame, corpus: DataFrame, scorer: Scorer, k: int, max_queries: int = MAX_QUERIES,
              cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best corpus rows per query.

    ``queries`` holds query_id and ``corpus`` chunk_id, both unique, plus what the scorer reads.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["chunk_id"]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"
    head = queries.limit(max_queries + 1).toPandas()
    if len(head) <= max_queries:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for first in batches:
                rows = _search(scorer, head, chain([first], batches), k)
                if len(rows):
                    yield best_rows(rows, first.schema.field("chunk_id").type)

        partial = corpus.mapInArrow(tidy(scan), schema)
    else:
        n_q = math.ceil(queries.count() / max_queries)
        n_c = math.ceil(corpus.count() / cell_rows)
        q = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_q)))
        q = q.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
        c = corpus.withColumn("_c", F.pmod(F.xxhash64("chunk_id"), F.lit(n_c)).cast("int"))
        c = c.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("_q", F.col("_q").cast("long"))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _search(scorer, left, [right], k)

        partial = q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInPandas(cell, schema)
    return best_of(partial, k)

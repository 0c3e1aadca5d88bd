"""A cell index for vectors: centres from a bounded sample, every vector in a cell, and searches that read cells by bound.

The dot product of a query with a vector is at most the one with the vector's centre plus the query's length times the cell's radius. An exact
search reads the cells nearest to each query, which puts a floor under its k-th score, and then only those whose bound reaches the
floor. A probing search stops after the first of these steps. Vectors lie in files by cell, so cells that no query needs are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.operators.topk import BestItems, best_of
from quirefold.session import shared_dir

SAMPLE = 20_000
MOST_CELLS = 1024
ROUNDS = 12
AT_ONCE = 4_000_000
SLACK = 1e-4  # scores are rounded to four decimals before they are ranked


@dataclass
class CellIndex:
    """centres (cells x dimension), size and radius of each cell, and the folder with the vectors by cell; read tells what the last search took."""

    centres: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    path: str
    kind: str
    read: dict = field(default_factory=dict)

    def vectors(self, spark, cells) -> DataFrame:
        schema = f"chunk_id {self.kind}, embedding array<double>, cell int"
        return spark.read.schema(schema).parquet(self.path).where(F.col("cell").isin([int(c) for c in cells]))


def as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def centres_of(sample: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Lloyd's k-means; a centre that loses all its vectors stays where it is."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=n)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, AT_ONCE // len(centres))
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(half - x[i : i + step] @ centres.T, axis=1) for i in range(0, len(x), step))])


def build_cells(vectors: DataFrame, cells: int | None = None) -> CellIndex:
    """The index of ``vectors`` (chunk_id, embedding, all of one length; null vectors are left out).

    Centres are fitted to at most ``SAMPLE`` vectors, those with the smallest hash of their id; every vector is in the cell of its nearest
    centre. By default there are as many cells as the root of the number of vectors, at most ``MOST_CELLS``.
    """
    spark = vectors.sparkSession
    rows = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    taken = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toArrow()
    path, kind = shared_dir(spark), dict(rows.dtypes)["chunk_id"]
    if not len(taken):
        return CellIndex(np.zeros((0, 0)), np.zeros(0), np.zeros(0), path, kind)
    sample = as_matrix(taken["embedding"].combine_chunks())
    n = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
    centres = centres_of(sample, min(n, len(sample)))

    def assign(batches):
        for batch in batches:
            own = nearest(as_matrix(batch.column("embedding")), centres) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["chunk_id", "embedding", "cell"])

    placed = rows.mapInArrow(assign, f"chunk_id {kind}, embedding array<double>, cell int")
    placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)

    def measure(batches):
        size, radius = np.zeros(len(centres)), np.zeros(len(centres))
        for batch in batches:
            own = batch.column("cell").to_numpy()
            gap = np.linalg.norm(as_matrix(batch.column("embedding")) - centres[own], axis=1)
            np.add.at(size, own, 1)
            np.maximum.at(radius, own, gap)
        at = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(size[at]), pa.array(radius[at])], names=["cell", "n", "radius"])

    stored = spark.read.schema(f"chunk_id {kind}, embedding array<double>, cell int").parquet(path)
    found = stored.mapInArrow(measure, "cell int, n double, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).toPandas()
    size, radius = np.zeros(len(centres)), np.zeros(len(centres))
    size[found["cell"]], radius[found["cell"]] = found["n"], found["radius"]
    return CellIndex(centres, size, radius, path, kind)


def _scan(q: np.ndarray, wanted: np.ndarray, k: int):
    """Scores of the queries that want a vector's cell (wanted: cells x queries), k rows per query and task."""

    def run(batches):
        best, kind = BestItems(len(q), k), None
        step = max(1, AT_ONCE // max(1, len(q)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                scores = np.clip((q @ as_matrix(batch.column("embedding")).T + 1) / 2, 0, 1).round(4)
                scores[~wanted[batch.column("cell").to_numpy()].T] = -np.inf
                best.add(scores, batch.column("chunk_id").to_numpy(zero_copy_only=False))
                kind = batch.schema.field("chunk_id").type
        if kind is not None:
            rows = best.rows(np.arange(len(q)))
            yield pa.RecordBatch.from_arrays([pa.array(rows["query_id"]), pa.array(rows["chunk_id"], kind), pa.array(rows["score"])], names=["query_id", "chunk_id", "score"])

    return run


def _some(index: CellIndex, spark, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    cells = np.flatnonzero(wanted.any(1) & (index.size > 0))
    return index.vectors(spark, cells).mapInArrow(_scan(q, wanted, k), f"query_id long, chunk_id {index.kind}, score double")


def cell_topk(queries: DataFrame, index: CellIndex, k: int = fv.DEPTH, share: float = 0.1, exact: bool = True, slice_rows: int = 4096) -> DataFrame:
    """(query_id, chunk_id, score, rank): top-k by (1 + dot) / 2, four decimals, ties by id.

    First every query's nearest cells are read, those with a ``share`` of all vectors and k at least. Without ``exact`` that is the answer; with
    it, cells whose bound reaches the k-th score follow, and the answer is that of a scan. Queries are taken in slices of
    ``slice_rows``, so that a task holds a bounded matrix; ``index.read`` counts pairs scored and all pairs.
    """
    spark = queries.sparkSession
    kind = dict(queries.dtypes)["query_id"]
    found = spark.createDataFrame([], f"query_id {kind}, chunk_id {index.kind}, score double")
    index.read.clear()
    index.read.update(scored=0, pairs=0)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n = max(1, -(-asked.count() // slice_rows)) if len(index.centres) else 0
    for i in range(n):
        part = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toPandas()
        if not len(part):
            continue
        q = np.stack(part["embedding"].to_numpy())
        to_centre = index.centres @ q.T
        bound = to_centre + index.radius[:, None] * np.linalg.norm(q, axis=1)
        order = np.argsort(-to_centre, axis=0)
        ahead = np.cumsum(index.size[order], axis=0) - index.size[order]
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, order, ahead < max(k, share * index.size.sum()), axis=0)
        near = best_of(_some(index, spark, q, wanted, k), k)
        if exact:
            kth = near.where(F.col("rank") == k).select("query_id", "score").toPandas()
            floor = np.full(len(q), -np.inf)
            floor[kth["query_id"]] = kth["score"]
            wanted |= np.clip((bound + 1) / 2, 0, 1) >= floor - SLACK
            near = best_of(_some(index, spark, q, wanted, k), k)
        index.read["scored"] += int((wanted * index.size[:, None]).sum())
        index.read["pairs"] += int(index.size.sum()) * len(q)
        names = spark.createDataFrame(pd.DataFrame({"no": np.arange(len(q)), "own": part["query_id"]}), f"no long, own {kind}")
        rows = near.join(F.broadcast(names), F.col("query_id") == F.col("no")).select(F.col("own").alias("query_id"), "chunk_id", "score")
        found = found.unionByName(rows)
    return best_of(found, k)

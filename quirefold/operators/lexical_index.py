"""An inverted index with block maxima, and exact BM25 top-k that skips what cannot reach a query's k-th score.

The index is made in shards of at most ``SHARD`` postings of chunks that lie together in the store. In a shard postings lie by term, the heaviest
first, in blocks of ``BLOCK``; a block's row tells its largest weight. A frequent term spreads over all shards and no task holds a whole list.

A slice of queries takes the blocks of its terms out of the index and is answered in two passes over these and two over the corpus store:

1. Each query's shortest lists give it ``SEEDS`` * k chunks. Their full scores, read from the store, put a floor under its k-th score.
2. Lists whose largest contributions together stay below the floor are left out, the longest first; what is left of the
   floor is spread evenly over the other lists, and their blocks below that share are left out too. A chunk that is in none of the
   blocks that remain cannot reach the floor.
3. The remaining blocks give partial scores. Chunks whose partial score plus everything left out reaches the floor are
   scored in full from the store, and the best k are the answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.operators import lexical as lx
from quirefold.operators.store import termed
from quirefold.operators.topk import best_of, filled
from quirefold.session import tidy, written

BLOCK = 128
SHARD = 1 << 21
SEEDS = 3
SEED_SHARE = 0.1
SLACK = 1e-6


def _blocks(block: int, shard: int, weigh):
    """Blocks of the store's rows, a shard of at most ``shard`` postings (or one row) at a time: in a shard a term's postings stand together, the heaviest first."""

    def run(batches):
        no, part = 0, TaskContext.get().partitionId() << 33

        def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal no
            rows = pa.Table.from_batches(held).combine_chunks()
            terms = rows["terms"].combine_chunks()
            flat, chunk = terms.flatten(), np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            weight = weigh(flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64), rows["length"].to_numpy().astype(np.float64)[chunk])
            coded = flat.field("term").dictionary_encode()
            names = coded.dictionary
            by_name = pc.sort_indices(names)
            code = np.empty(len(names), np.int64)
            code[by_name.to_numpy()] = np.arange(len(names))
            code = code[coded.indices.to_numpy(zero_copy_only=False)]
            order = np.lexsort((-weight, code))
            code, weight, n = code[order], weight[order], len(order)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if n else np.zeros(0, np.int64)
            starts = np.flatnonzero((np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % block == 0)
            ends = np.append(starts, n)[1:]
            offsets = pa.array(np.append(starts, n).astype(np.int32))
            ids = pa.array(part + no + np.arange(len(starts)), pa.int64())
            no += len(starts)
            chunk_ids = rows["chunk_id"].combine_chunks().take(pa.array(chunk[order]))
            lists = [pa.ListArray.from_arrays(offsets, values) for values in (chunk_ids, pa.array(weight))]
            name = names.take(by_name.take(pa.array(code[starts])))
            return pa.RecordBatch.from_arrays([name, ids, pa.array(weight[starts]), pa.array((ends - starts).astype(np.int32)), *lists], names=["term", "block", "top", "n", "chunk_ids", "weights"])

        held, size = [], 0
        for batch in batches:
            count = batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            total, a = np.append(0, np.cumsum(count, dtype=np.int64)), 0
            while a < batch.num_rows:
                b = int(np.searchsorted(total, total[a] + shard - size, "right")) - 1
                if b <= a and held:
                    yield cut(held)
                    held, size = [], 0
                    continue
                b = max(b, a + 1)
                held.append(batch.slice(a, b - a))
                size += int(total[b] - total[a])
                a = b
        if held:
            yield cut(held)

    return tidy(run)


@dataclass
class LexicalIndex:
    """store (chunk_id, length, terms), counts, avg_len, and blocks (term, block, top, n, chunk_ids, weights); read tells what the last search took."""

    store: DataFrame
    counts: DataFrame
    avg_len: float
    blocks: DataFrame
    read: dict = field(default_factory=dict)

    def weigh(self):
        """Without the index itself, which tasks cannot hold."""
        avg_len = self.avg_len
        return lambda tf, length: lx.bm25_weight(tf, length, avg_len)


def build_index(corpus: DataFrame, counts: DataFrame | None = None, block: int = BLOCK, shard: int = SHARD) -> LexicalIndex:
    """The index of texts or of a store. Postings are not shuffled: a task makes shards of the rows it reads, and counts come from the blocks."""
    store = corpus if "terms" in corpus.columns else written(termed(corpus))
    lengths = store.groupBy("length").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(lx.LENGTH_MARK), F.col("length")).alias("term"), "n")
    lengths = written(lengths) if counts is None else counts
    avg_len = lx.corpus_size(lengths).first()["avg_len"] or 1.0
    kind = dict(store.dtypes)["chunk_id"]
    made = _blocks(block, shard, lambda tf, length: lx.bm25_weight(tf, length, avg_len))
    blocks = written(store.select("chunk_id", "length", "terms").mapInArrow(made, f"term string, block long, top double, n int, chunk_ids array<{kind}>, weights array<double>"))
    if counts is None:
        counts = written(blocks.groupBy("term").agg(F.sum("n").alias("n")).unionByName(lengths))
    return LexicalIndex(store, counts, avg_len, blocks)


@dataclass
class _Plan:
    """Per entry of a slice's (query, term) pairs: what its list holds and what is read of it."""

    asked: lx.QueryTerms
    term: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    size: np.ndarray
    top: np.ndarray

    @classmethod
    def of(cls, asked: lx.QueryTerms, blocks: DataFrame) -> _Plan:
        lists = blocks.groupBy("term").agg(F.sum("n").alias("n"), F.max("top").alias("top")).toPandas()
        size, top = (dict(zip(lists["term"], lists[c], strict=True)) for c in ("n", "top"))
        term = np.repeat(np.arange(len(asked.terms)), np.diff(asked.first))
        name = asked.terms.to_pylist()
        return cls(
            asked, term, asked.query, asked.weight, np.array([size.get(name[t], 0) for t in term], np.int64),
            asked.weight * np.array([top.get(name[t], 0.0) for t in term], np.float64),
        )

    def by_query(self):
        order = np.argsort(self.query, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.query[order])) + 1) if len(order) else []

    def seed_lists(self, k: int) -> np.ndarray:
        """The shortest lists of each query, up to a share of all its postings but enough for its seeds."""
        take = np.zeros(len(self.term), bool)
        for at in self.by_query():
            at = at[np.argsort(self.size[at], kind="stable")]
            ahead = np.cumsum(self.size[at])
            take[at] = (ahead <= SEED_SHARE * ahead[-1]) | (ahead - self.size[at] < 2 * k)
        return take

    def needed(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the contribution from which its blocks are read (infinite: none), and for each query what all unread ones add up to at most."""
        least, rest = np.zeros(len(self.term)), np.zeros(len(self.asked.ids))
        for at in self.by_query():
            q = self.query[at[0]]
            open_, left = floor[q] - SLACK, []
            for e in at[np.argsort(-self.size[at] / np.maximum(self.top[at], 1e-300), kind="stable")]:
                if self.top[e] < open_:
                    open_ -= self.top[e]
                    rest[q] += self.top[e]
                    least[e] = np.inf
                else:
                    left.append(e)
            tops = np.sort(self.top[left])
            share, n = 0.0, len(tops)
            for i, t in enumerate(tops):  # the largest share s with sum(min(s, top)) below what is open
                share = max(0.0, open_ - tops[:i].sum()) / (n - i)
                if share <= t:
                    break
            least[left] = share
            rest[q] += np.minimum(share, self.top[left]).sum()
        return least, rest


def _partial(blocks: DataFrame, plan: _Plan, least: np.ndarray) -> DataFrame:
    """(q, chunk_id, seen, n) of the ``blocks`` that reach ``least`` for a query; the slice's own (query, term) rows are what is broadcast."""
    spark = blocks.sparkSession
    use = np.isfinite(least)
    name = np.array(plan.asked.terms.to_pylist(), object)
    asked = spark.createDataFrame(
        pd.DataFrame({"term": name[plan.term[use]], "q": plan.query[use], "w": plan.weight[use], "least": least[use]}), "term string, q long, w double, least double"
    )
    met = blocks.join(F.broadcast(asked), "term").where("top * w > least or least = 0")
    each = met.select("q", "w", F.inline(F.arrays_zip("chunk_ids", "weights")))
    return each.groupBy("q", F.col("chunk_ids").alias("chunk_id")).agg(F.sum(F.col("w") * F.col("weights")).alias("seen"), F.count(F.lit(1)).alias("n"))


def _score(asked: lx.QueryTerms, weigh):
    """Full scores of the (query, chunk) pairs that are asked for, from a chunk's own terms."""

    def run(batches):
        for whole in batches:
            for batch, q, d, x in lx.matches(asked, whole, weigh):
                n = batch.num_rows
                wanted = batch.column("qs")
                pair_chunk = np.repeat(np.arange(n), wanted.value_lengths().to_numpy(zero_copy_only=False))
                pair_query = wanted.flatten().to_numpy(zero_copy_only=False)
                scores = np.bincount(q * n + d, weights=x, minlength=len(asked.ids) * n).astype(np.float64)[pair_query * n + pair_chunk]
                chunk = batch.column("chunk_id").take(pa.array(pair_chunk))
                yield pa.RecordBatch.from_arrays([pa.array(pair_query), chunk, pa.array(scores.round(lx.DECIMALS))], names=["query_id", "chunk_id", "score"])

    return tidy(run)


def _scored(index: LexicalIndex, asked: lx.QueryTerms, pairs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score), the query by its number in the slice, of pairs (q, chunk_id)."""
    wanted = pairs.groupBy("chunk_id").agg(F.collect_list("q").alias("qs"))
    rows = index.store.select("chunk_id", "length", "terms").join(wanted, "chunk_id")
    return rows.mapInArrow(_score(asked, index.weigh()), f"query_id long, chunk_id {dict(index.store.dtypes)['chunk_id']}, score double")


def _search(index: LexicalIndex, asked: lx.QueryTerms, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of one slice; query_id is the query's number in it."""
    names = index.blocks.sparkSession.createDataFrame(pd.DataFrame({"term": asked.terms.to_pandas()}), "term string")
    blocks = written(index.blocks.join(F.broadcast(names), "term"))
    plan = _Plan.of(asked, blocks)
    seeds = _partial(blocks, plan, np.where(plan.seed_lists(k), 0.0, np.inf))
    first = best_of(seeds.select(F.col("q").alias("query_id"), "chunk_id", F.col("seen").alias("score")), SEEDS * k).select(F.col("query_id").alias("q"), "chunk_id")
    first = written(first)  # a few rows per query: once their size is known, the store need not be shuffled to meet them
    ranked = best_of(_scored(index, asked, first), k).where(F.col("rank") == k).select("query_id", "score").toPandas()
    floor = np.zeros(len(asked.ids))
    floor[ranked["query_id"]] = ranked["score"]
    least, rest = plan.needed(floor)
    partial = written(_partial(blocks, plan, least))
    bounds = index.blocks.sparkSession.createDataFrame(pd.DataFrame({"q": np.arange(len(floor)), "missing": floor - rest - SLACK}), "q long, missing double")
    hopeful = written(partial.join(F.broadcast(bounds), "q").where("seen >= missing").select("q", "chunk_id"))
    index.read["postings"] = index.read.get("postings", 0) + int(plan.size.sum())
    index.read["seeds"] = index.read.get("seeds", 0) + int(plan.size[plan.seed_lists(k)].sum())
    index.read["read"] = index.read.get("read", 0) + (partial.agg(F.sum("n")).first()[0] or 0)
    index.read["scored"] = index.read.get("scored", 0) + hopeful.count()
    return _scored(index, asked, hopeful)


def index_topk(queries: DataFrame, index: LexicalIndex, k: int = fv.DEPTH) -> DataFrame:
    """As :func:`quirefold.operators.lexical.bm25_topk`, row for row, from the index.

    Where a query's term has an idf of zero or less (the mean idf of a tiny corpus can be negative), partial scores bound nothing and the store
    is scanned instead.
    """
    known = written(lx.query_terms(queries, lx.term_stats(index.counts)))
    floor = known.select(F.min(F.array_min(F.transform("terms", lambda t: t["idf"])))).first()[0]
    if floor is not None and floor <= 0:
        return lx.bm25_topk(queries, index.store, k, counts=index.counts)
    index.read.clear()
    found = None
    kind = dict(queries.dtypes)["query_id"]
    for asked in lx.slices(lx.bm25_weights(known)):
        names = index.blocks.sparkSession.createDataFrame(pd.DataFrame({"no": np.arange(len(asked.ids)), "own": asked.ids}), f"no long, own {kind}")
        part = _search(index, asked, k).where("score > 0").join(F.broadcast(names), F.col("query_id") == F.col("no"))
        part = part.select(F.col("own").alias("query_id"), "chunk_id", "score")
        found = part if found is None else found.unionByName(part)
    return filled(best_of(found, k), queries, index.store, k)

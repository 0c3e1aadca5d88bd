"""Sentence-aware chunks with overlap where no task sees a whole document.

A chunk is fixed by the last sentence ``l`` of the chunk before it: it starts with the shortest tail of at least ``overlap`` tokens that ends in
``l`` and ends at the first later sentence behind which the next one would pass ``target`` (with ``minimum`` tokens in it). As a sentence has one token
at least, both lie within a bounded distance of ``l``. So a document's sentences are dealt out in blocks of ``block``, each with a
margin of its neighbours, and every block knows where each ``l`` in it leads.

Only which ``l`` are reached depends on what comes before. For documents of several blocks each block is reduced to a table: entered at this
offset, it is left into the next block at that one. These tables are composed with themselves, so that they lead 1, 2, 4, ... blocks on, and
as many joins of the reached entries give the entry of every block. A last pass cuts each block from its entry on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import estimate_tokens, split_sentences
from quirefold.session import small_side, written

BLOCK = 4096
PLACED = ["page_number", "section_title", "x0", "y0", "x1", "y1"]


def document_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, n from 1, sentence, tokens) of plain documents."""
    parts = docs.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("n", "sentence"))
    return parts.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "sentence", estimate_tokens(F.col("sentence")).alias("tokens"))


def block_sentences(blocks: DataFrame, *order: str) -> DataFrame:
    """Sentences of ordered blocks (doc_id, ``order``, text, page_number, section_title, x0, y0, x1, y1), numbered through each document.

    The numbers come from a running count over one row per block without its text. The blocks are written first, as the count and the
    sentences both read them.
    """
    keys = ["doc_id", *order]
    split = written(blocks.select(*keys, *[c for c in PLACED if c not in keys], split_sentences(F.col("text")).alias("sentences")))
    ahead = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = split.select(*keys, F.size("sentences").alias("k")).withColumn("ahead", F.coalesce(F.sum("k").over(ahead), F.lit(0)))
    joined = split.join(counts.drop("k"), keys)
    rows = joined.select("doc_id", "ahead", *PLACED, F.posexplode("sentences").alias("at", "sentence"))
    return rows.select("doc_id", (F.col("ahead") + F.col("at") + 1).alias("n"), "sentence", estimate_tokens(F.col("sentence")).alias("tokens"), *PLACED)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, of batches sorted by it; what is held is one key's rows and a batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        at = np.flatnonzero(new)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(at[-1])
    if held is not None:
        yield held


class _Cuts:
    """The chunks of one block: for every state ``l`` where its chunk starts and ends. Sentences are numbers ``first`` and on of the document."""

    def __init__(self, numbers: np.ndarray, tokens: np.ndarray, block_no: int, block: int, target: int, overlap: int, minimum: int):
        self.first = int(numbers[0])
        self.total = np.concatenate(([0], np.cumsum(tokens)))
        own = (numbers - 1) // block == block_no
        self.low, count = block_no * block, int(own.sum())
        self.states = self.low + np.arange(count)
        at = self.states - self.first + 1  # how many of the rows at hand end with l
        before = self.total[at]
        start = np.searchsorted(self.total, before - overlap, "right") - 1
        self.start = np.maximum(start, 0)
        if self.low == 0:
            self.start[0] = 0
        base = self.total[self.start]
        n = len(tokens)
        full = np.searchsorted(self.total, base + target, "right") - 1  # rows at hand up to which the target is not passed
        enough = np.searchsorted(self.total, base + minimum, "left")
        last = np.maximum(np.maximum(full, enough), at + 1)
        self.ends = last >= n
        self.last = np.minimum(last, n)
        self.next = self.last + self.first - 1  # the sentence number of the last row

    def tokens(self, i: int) -> int:
        return int(self.total[self.last[i]] - self.total[self.start[i]])


def _exits(block: int, reach: int, limits: tuple[int, int, int]):
    def run(batches):
        for table in _runs(batches, ["doc_id", "block"]):
            no = table["block"][0].as_py()
            cuts = _Cuts(table["n"].to_numpy(), table["tokens"].to_numpy(), no, block, *limits)
            stop = len(cuts.states)
            to = np.append(np.where(cuts.ends | (cuts.next >= cuts.low + block), stop, cuts.next - cuts.low), stop)
            out = np.append(np.where(cuts.ends, -1, cuts.next - cuts.low - block), -1)
            way = np.where(to == stop, np.arange(stop + 1), to)
            for _ in range(max(1, stop.bit_length())):
                way = way[way]
            entries = np.arange(min(reach, stop) if no else 1)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(entries), np.int64))), pa.array(np.full(len(entries), no)), pa.array(entries), pa.array(out[way[entries]])],
                names=["doc_id", "block", "entry", "exit"],
            )

    return run


def _chunks(block: int, limits: tuple[int, int, int], placed: bool):
    def run(batches):
        for table in _runs(batches, ["doc_id", "block"]):
            no, entry = table["block"][0].as_py(), table["entry"][0].as_py()
            cuts = _Cuts(table["n"].to_numpy(), table["tokens"].to_numpy(), no, block, *limits)
            picked, i = [], entry
            while i < len(cuts.states):
                picked.append(i)
                if cuts.ends[i]:
                    break
                i = int(cuts.next[i] - cuts.low)
            sentences = table["sentence"].to_pylist()
            spans = [(int(cuts.start[i]), int(cuts.last[i])) for i in picked]
            texts = [" ".join(sentences[a:b]) for a, b in spans]
            m = len(picked)
            columns = [
                table["doc_id"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(m, np.int64))), pa.array(np.full(m, no)), pa.array(np.arange(m)),
                pa.array([a + cuts.first for a, _ in spans], pa.int64()), pa.array([b + cuts.first - 1 for _, b in spans], pa.int64()),
                pa.array([cuts.tokens(i) for i in picked], pa.int64()), pa.array([t if t.endswith(".") else t + "." for t in texts], pa.string()),
            ]
            names = ["doc_id", "block", "place", "first_sentence", "last_sentence", "token_count", "content"]
            if placed:
                heads = pa.array([a for a, _ in spans], pa.int64())
                columns += [table[c].combine_chunks().take(heads) for c in ("page_number", "section_title")]
                ok = table["x0"].is_valid().to_numpy() & table["y0"].is_valid().to_numpy()
                for c, pick in (("x0", np.min), ("y0", np.min), ("x1", np.max), ("y1", np.max)):
                    edge = table[c].to_numpy()
                    columns.append(pa.array([round(float(pick(edge[a:b][ok[a:b]])), 2) if ok[a:b].any() else 0.0 for a, b in spans], pa.float64()))
                names += PLACED
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def chunk_sentences(sentences: DataFrame, target: int = fv.CHUNK_TARGET, overlap: int = fv.CHUNK_OVERLAP, minimum: int = fv.CHUNK_MIN, block: int = BLOCK) -> DataFrame:
    """Chunks (doc_id, chunk_index, first_sentence, last_sentence, token_count, sentence_count, content) of numbered sentences.

    ``sentences``: doc_id, n (1, 2, ... without a gap), sentence, tokens (1 at least); with page_number, section_title and a box, a chunk has those of its
    first sentence and the box around all of them. As :func:`quirefold.operators.chunking.chunk_documents` cuts them, but a
    document of any length is spread over its blocks. A document without sentences has no chunk.
    """
    if not 0 < overlap <= minimum:
        raise ValueError("the overlap must be positive and no larger than the least chunk")
    reach, back = max(target, minimum) + 2, overlap + 1
    if block < max(reach, back):
        raise ValueError(f"blocks must hold {max(reach, back)} sentences at least")
    limits = (target, overlap, minimum)
    kind = dict(sentences.dtypes)["doc_id"]
    own, place = F.expr(f"(n - 1) div {block}"), F.expr(f"(n - 1) % {block}")
    homes = F.filter(F.array(own, F.when((place < reach) & (own > 0), own - 1), F.when(place >= block - back, own + 1)), lambda b: b.isNotNull())
    laid = written(sentences.withColumn("tokens", F.col("tokens").cast("long")).select("*", F.explode(homes).alias("block")))
    # read back, as the sentences would be made once more; a margin is no block of its own: the last block of a document has sentences of its own
    lengths = laid.groupBy("doc_id").agg(F.max("n").alias("size"))
    long = written(lengths.where(F.col("size") > block))
    most = long.agg(F.max("size")).first()[0] or 0
    entered = long.select("doc_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("entry"))
    if most:
        slim = laid.select("doc_id", "block", "n", "tokens").join(long, "doc_id").where(f"block <= (size - 1) div {block}")
        sorted_ = slim.drop("size").repartition("block", "doc_id").sortWithinPartitions("doc_id", "block", "n")
        jumps = written(sorted_.mapInArrow(_exits(block, reach, limits), f"doc_id {kind}, block long, entry long, exit long"))
        step, blocks = 1, -(-most // block)
        while step < blocks:
            onward = entered.join(jumps, ["doc_id", "block", "entry"]).where("exit >= 0")
            entered = written(entered.unionByName(onward.select("doc_id", (F.col("block") + step).alias("block"), F.col("exit").alias("entry"))))
            if 2 * step < blocks:
                then = jumps.select("doc_id", (F.col("block") - step).alias("block"), F.col("entry").alias("exit"), F.col("exit").alias("then"))
                jumps = written(jumps.join(then, ["doc_id", "block", "exit"]).select("doc_id", "block", "entry", F.col("then").alias("exit")))
            step *= 2
    placed = "page_number" in sentences.columns
    starts = entered.join(long, "doc_id")
    rows = laid.join(small_side(starts.select("doc_id", "block", "entry")), ["doc_id", "block"], "left").join(small_side(long.select("doc_id", F.lit(True).alias("several"))), "doc_id", "left")
    rows = rows.where("entry is not null or (several is null and block = 0)").withColumn("entry", F.coalesce("entry", F.lit(0).cast("long"))).drop("several")
    extra = "".join(f", {c} {dict(sentences.dtypes)[c]}" for c in PLACED[:2]) + "".join(f", {c} double" for c in PLACED[2:]) if placed else ""
    # not by the join's own keys in their order: such a shuffle is left out as one too many, and a join that turns to a broadcast at run time
    # then reads its shuffle where it lies, which would part a block
    sorted_ = rows.repartition("block", "doc_id").sortWithinPartitions("doc_id", "block", "n")
    cut = sorted_.mapInArrow(_chunks(block, limits, placed), f"doc_id {kind}, block long, place long, first_sentence long, last_sentence long, token_count long, content string{extra}")
    if most:
        cut = written(cut)
        counts = cut.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("k"))
        before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.join(counts.select("doc_id", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead")), ["doc_id", "block"])
        cut = cut.withColumn("place", F.col("place") + F.col("ahead"))
    return cut.select(
        "doc_id", F.col("place").cast("int").alias("chunk_index"), F.col("first_sentence").cast("int").alias("first_sentence"), F.col("last_sentence").cast("int").alias("last_sentence"),
        F.col("token_count").cast("int").alias("token_count"), (F.col("last_sentence") - F.col("first_sentence") + 1).cast("int").alias("sentence_count"), "content", *(PLACED if placed else []),
    )

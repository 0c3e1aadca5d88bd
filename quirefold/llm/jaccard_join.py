"""Exact Jaccard self-join of word-shingle sets by token-combination prefixes.

Two sets with |x ∩ y| * den >= num * |x ∪ y| differ from x in at most slack(n) = n - ceil(num n / den) tokens.
Tokens have one global order: rare class first, then the frequent class, each by hash. The class
comes from counts over the whole corpus in ``BINS`` bins (a bin is frequent above ``FREQUENT`` times
the mean), a table of fixed size.

* A set with more than slack rare tokens is indexed under its first slack + 1 rare tokens.
* Otherwise it is indexed under all its rare tokens and its prefix is extended to slack + 2 tokens. Frequent tokens are not
  indexed alone: every pair of frequent prefix tokens is one signature. Removing slack tokens cannot destroy all
  signatures, so linked sets share one.
* Sets of ``LARGE`` tokens and more would make too many pairs; they are indexed under single frequent tokens, and sets close
  enough in size to be linked with such a set carry both kinds.

Signatures held by one text only fall out of an aggregation. In each remaining group every member
is compared with the group's first text, which links groups of copies with a number of comparisons linear in
the group. Only texts of one group that are still in different components are then compared with each other, behind
two exact bounds: the sizes, and the parity bit maps (``8 * 64`` bits, their difference never exceeds that of the sets).
Long sets fill those maps, so a third bound compares maps as long as the sets (folded to the shorter of two).
Whatever is left is verified on the full sets. No link is lost and no group is gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import arrays as A
from quirefold.llm.components import components
from quirefold.session import release, written

BINS = 1 << 20
SLABS = 64
FREQUENT = 4.0
LANES = 8
SMALL_PAIRS = 64

SETS = "doc_id long, n long, k1 long, k2 long, " + ", ".join(f"p{i} long" for i in range(LANES)) + ", parity binary, slab int, counts array<int>"


def slack(n: int | np.ndarray, num: int, den: int):
    return n - -(-n * num // den)


def large_from(num: int, den: int) -> int:
    """Smallest set whose frequent tokens could make too many pairs."""
    return SMALL_PAIRS * den // (den - num)


def shingle_sets(column: pa.Array, width: int):
    """Chunks of whole texts as (tokens, offsets): the sorted distinct 64-bit shingle hashes of each text, end to end."""
    data, starts = A.text_bytes(column)
    for first, last in A.chunks(starts):
        part = data[starts[first] : starts[last]]
        begin, end, at = A.words(part, starts[first : last + 1] - starts[first])
        hashes = A.word_hashes(part, begin, end)
        grams = hashes.copy()
        for k in range(1, width):
            grams = A.mix(grams[:-1] * np.uint64(3) + hashes[k:]) if len(grams) > 1 else grams[:0]
        size = np.diff(at)
        for i in np.flatnonzero((size > 0) & (size < width)):  # the whole sequence is the one shingle
            short = hashes[at[i] : at[i] + 1]
            for k in range(at[i] + 1, at[i + 1]):
                short = A.mix(short * np.uint64(3) + hashes[k])
            grams = np.append(grams, np.zeros(max(0, at[i] + 1 - len(grams)), np.uint64))
            grams[at[i]] = A.mix(short + np.uint64(size[i]))[0]
        count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        tokens = grams[A.ragged(at[:-1], count)]
        ends = np.cumsum(count)
        for i, j in zip(ends - count, ends, strict=True):
            tokens[i:j].sort()
        fresh = np.ones(len(tokens) + 1, bool)
        fresh[1:-1] = tokens[1:] != tokens[:-1]
        fresh[ends - count] = True
        fresh = fresh[:-1]
        offsets = np.concatenate(([0], np.cumsum(fresh)))[np.concatenate(([0], ends))]
        yield tokens[fresh], offsets


def _bins(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _long_parity(tokens: np.ndarray) -> bytes | None:
    """The parity of the tokens in about as many bits as there are tokens; short sets need none beside the fixed map."""
    if len(tokens) <= LANES * 32:
        return None
    bits = 1 << len(tokens).bit_length()
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bits in which two long maps differ, after the larger is folded to the length of the smaller."""
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is not None and y is not None:
            u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(u), len(v))
            u, v = (np.bitwise_xor.reduce(w.reshape(-1, size)) for w in (u, v))
            out[i] = np.bitwise_count(u ^ v).sum()
    return pd.Series(out)


def _describe(width: int):
    def run(batches):
        counts = np.zeros(BINS, np.int32)
        bits = LANES * 64
        names = [f.split()[0] for f in SETS.split(", ")]
        for batch in batches:
            parts, maps = [], []
            for tokens, offsets in shingle_sets(batch.column("text"), width):
                np.add.at(counts, _bins(tokens), 1)
                m = len(offsets) - 1
                lane = np.repeat(np.arange(m), np.diff(offsets)) * bits + (tokens & np.uint64(bits - 1)).astype(np.int64)
                parity = np.packbits((np.bincount(lane, minlength=m * bits) & 1).astype(np.uint8)).view(np.int64).reshape(m, LANES)
                maps.extend(_long_parity(tokens[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True))
                parts.append((np.diff(offsets), _sums(A.mix(tokens), offsets), _sums(A.mix(tokens + np.uint64(77)), offsets), *parity.T))
            ints = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)] or [pa.array([], pa.int64())] * (3 + LANES)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *ints, pa.array(maps, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int32()))], names=names)
        size = BINS // SLABS
        for i in range(SLABS):
            slab = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(counts[i * size : (i + 1) * size]))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * (4 + LANES) + [pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), slab], names=names)

    return run


def frequent_bins(described: DataFrame) -> np.ndarray:
    """One flag per bin; the driver gets at most ``BINS`` numbers, whatever the corpus."""
    each = described.where("slab is not null").select("slab", F.posexplode("counts").alias("i", "c"))
    got = each.groupBy((F.col("slab") * (BINS // SLABS) + F.col("i")).alias("bin")).agg(F.sum(F.col("c").cast("long")).alias("c")).where("c > 0").toArrow()
    counts = np.zeros(BINS, np.int64)
    counts[got["bin"].to_numpy()] = got["c"].to_numpy()
    return counts > max(64.0, FREQUENT * counts.mean())


def signatures(tokens: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of one sorted set; see the module's text."""
    n = len(tokens)
    spare = slack(n, num, den)
    hot = frequent[_bins(tokens)]
    rare = tokens[~hot]
    if len(rare) > spare:
        return A.mix(rare[: spare + 1])
    common, large = tokens[hot], large_from(num, den)
    singles, pairs = n >= large * num // den, n < large
    out = [A.mix(rare)]
    if singles:
        out.append(A.mix(common[: spare + 1 - len(rare)] + np.uint64(1)))
    if pairs:
        ends = common[: spare + 2 - len(rare)]
        i, j = np.triu_indices(len(ends), 1)
        out.append(A.mix(A.mix(ends[i]) + ends[j] + np.uint64(2)))
    return np.concatenate(out)


def _index(width: int, num: int, den: int, frequent: np.ndarray):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            done = 0
            for tokens, offsets in shingle_sets(batch.column("text"), width):
                mine = ids[done : done + len(offsets) - 1]
                done += len(mine)
                size = np.diff(offsets)
                row = np.repeat(np.arange(len(mine)), size)
                rare = ~frequent[_bins(tokens)]
                before = np.concatenate(([0], np.cumsum(rare)))
                spare = slack(size, num, den)
                plain = before[offsets[1:]] - before[offsets[:-1]] > spare
                take = rare & plain[row] & (before[:-1] - before[offsets[:-1]][row] <= spare[row])
                sig, owner = [A.mix(tokens[take])], [mine[row[take]]]
                for i in np.flatnonzero(~plain & (size > 0)):
                    sig.append(signatures(tokens[offsets[i] : offsets[i + 1]], frequent, num, den))
                    owner.append(np.full(len(sig[-1]), mine[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(owner))], names=["sig", "doc_id"])

    return run


def _sets_of(width: int, wanted: A.IdFilter):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.maybe(batch.column("slot").to_numpy(zero_copy_only=False))))
            ids, done = batch.column("doc_id").cast(pa.int64()), 0
            for tokens, offsets in shingle_sets(batch.column("text"), width):
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(offsets) - 1), sets], names=["doc_id", "tokens"])
                done += len(offsets) - 1

    return run


def _close(a: str, b: str, num: int, den: int):
    """Bounds that no linked pair violates: sizes, and the difference of the parity maps."""
    apart = " + ".join(f"bit_count({a}.p{i} ^ {b}.p{i})" for i in range(LANES))
    return F.expr(
        f"{a}.n * {den} >= {b}.n * {num} and {b}.n * {den} >= {a}.n * {num}"
        f" and ({apart}) * {num + den} <= ({a}.n + {b}.n) * {den - num}"
    )


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked, judged on their full sets."""
    apart = F.pandas_udf(_apart, "long")
    maps = classes.select("doc_id", "n", "parity")
    for c in "ba":
        pairs = pairs.join(maps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")), c)
    pairs = written(pairs.where(apart("pa", "pb") * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b"))
    release(texts.sparkSession)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    slotted = texts.withColumn("slot", A.IdFilter.slot_column("doc_id"))
    sets = slotted.mapInArrow(A.tidy(_sets_of(width, A.IdFilter.of(ids, "doc_id"))), "doc_id long, tokens array<long>")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(right, "b").join(left, "a").withColumn("both", both)
        .where(F.col("both") * den >= (F.size("ta") + F.size("tb") - F.col("both")) * num).select("a", "b").distinct()
    )


def link_components(
    docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A text's set holds its distinct ``width``-word shingles, words being runs of non-space characters with A-Z folded; with fewer words the
    whole sequence is its one shingle. Two texts are linked when intersection * den >= union * num, and
    component_id is the smallest id reachable by links. Null or blank texts have an empty set and are linked with nothing; rows with
    a null id come back with a null component; equal rows each come back; rows that share an id count as one node.
    Other columns of ``docs`` are not read. No rows give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = written(texts.mapInArrow(A.tidy(_describe(width)), SETS))
    frequent = frequent_bins(described)
    release(docs.sparkSession)
    info = described.where("slab is null").drop("slab", "counts")
    classes = info.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n", *[f"p{i}" for i in range(LANES)]).agg(F.min("doc_id").alias("doc_id"), F.first("parity").alias("parity"))
    index = texts.where("doc_id is not null").mapInArrow(A.tidy(_index(width, num, den, frequent)), "sig long, doc_id long")
    groups = index.groupBy("sig").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("sig", "lead")
    classes = written(classes)
    members = written(index.join(groups, "sig").join(classes.drop("k1", "k2", "parity"), "doc_id"))
    release(docs.sparkSession)

    lead = classes.select(F.col("doc_id").alias("lead"), *[c for c in classes.columns if c not in ("doc_id", "k1", "k2", "parity")])
    first = (
        members.where("doc_id <> lead").select(*members.drop("sig").columns).distinct().alias("x").join(lead.alias("y"), F.expr("x.lead = y.lead"))
        .where(_close("x", "y", num, den)).select(F.col("y.lead").alias("a"), F.col("x.doc_id").alias("b")).distinct()
    )
    links = written(verify(first, classes, texts, width, num, den))
    tied = components(links)

    placed = members.drop("lead").join(tied.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("sig")
    open_rows = written(placed.join(mixed, "sig"))
    release(docs.sparkSession)
    final = tied
    if not open_rows.isEmpty():
        x, y = open_rows.alias("x"), open_rows.alias("y")
        across = (
            x.join(y, F.expr("x.sig = y.sig")).where("x.doc_id < y.doc_id and x.component <> y.component").where(_close("x", "y", num, den))
            .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
        )
        more = verify(across, classes, texts, width, num, den)
        final = components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))  # a found component enters as a star, not link by link
    final = final.select(F.col("node").alias("rep"), "component")
    by_class = classes.select("k1", "k2", F.col("doc_id").alias("rep")).join(final, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("found"))
    return (
        info.join(by_class, ["k1", "k2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("found"))).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_first(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; rows without an id stay."""
    kept = link_components(docs, width, num, den).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))

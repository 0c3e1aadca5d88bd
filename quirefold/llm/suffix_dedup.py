"""Exact removal of long repeated byte strings: interval expansion on a Burrows-Wheeler transform.

A byte goes when it is covered by a string of ``limit`` bytes that also starts anywhere else. Windows of ``limit`` bytes are
brought together without sorting all suffixes of the corpus:

1. Every window owns an anchor, its smallest 32-byte gram by hash (the last on a tie). Equal windows have equal anchors at equal places, so only windows with the
   same anchor can be equal. Neighbouring windows share their anchor and form one segment (about one per 80 bytes).
2. Anchors that occur once end there. Where all segments of an anchor are the same bytes, or a segment occurs twice, its windows repeat.
3. The different segments of one anchor (edges of passages, edited copies) are joined to one string with a terminator each; a task takes
   many anchors at once, up to ``BATCH`` bytes. On its Burrows-Wheeler transform, intervals of equal prefixes are extended backward breadth
   first (from the ranks of 32-byte prefixes, which the construction of the transform yields anyway), which sets the common prefix of neighbouring suffixes by increasing value. The expansion stops at ``limit``:
   what is unset then shares at least ``limit`` bytes.
4. An anchor with more than ``GROUP`` different segments would make a large group. Its windows are parted by their distance to the anchor, four parts at a time, and the
   bytes common to a part join the key, until groups are small; at single windows the key is the whole window. Nothing is capped.

Segments, anchors and parts are joined by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import arrays as A
from quirefold.session import release, written

ANCHOR = 32
GROUP = 48
BATCH = 1 << 18
START = 32
LOW = np.uint64(0xFFFFFFFF)
SEGMENTS = "anchor long, seg long, row long, lo long, hi long, apos long"


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of keys[p : p + width] for each p."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = keys
    block = padded.reshape(-1, width)
    back = np.empty_like(block)
    np.minimum.accumulate(block[:, ::-1], axis=1, out=back[:, ::-1])
    least = back.ravel()[: n - width + 1]
    np.minimum.accumulate(block, axis=1, out=block)
    return np.minimum(least, padded[width - 1 : n], out=least)


def segments(data: np.ndarray, starts: np.ndarray, limit: int):
    """(text, anchor, seg, lo, hi, apos) of every segment; positions count from the start of the text.

    A chunk's arrays have eight bytes per byte of text, so those that are done with are written over or let go.
    """
    anchor = min(ANCHOR, limit)
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(starts) - limit + 1, 0)
    if len(data) < limit or not count.any():
        return none, none, none, none, none, none
    prefix = A.prefix_hash(data)
    grams = prefix[anchor:] - prefix[:-anchor]
    grams *= A.powers(len(prefix))[1][: len(data) - anchor + 1]
    grams = A.mix(grams)
    keys = grams & ~LOW
    keys |= np.arange(int(LOW), int(LOW) - len(grams), -1, dtype=np.int64).view(np.uint64)
    at = sliding_least(keys, limit - anchor + 1)
    del keys
    at &= LOW
    at = np.subtract(LOW, at, out=at).view(np.int64)
    place = A.ragged(starts[:-1], count)
    chosen = at[place]
    del at
    fresh = np.ones(len(place), bool)
    np.not_equal(chosen[1:], chosen[:-1], out=fresh[1:])
    ends = np.cumsum(count)
    fresh[(ends - count)[count > 0]] = True
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(place)])) - 1
    lo, hi, apos, text = place[first], place[last], chosen[first], np.searchsorted(ends, first, "right")
    del place, chosen
    seg = A.spans_hash(prefix, lo, hi + limit)
    base = starts[text]
    return text, A.mix(grams[apos]).view(np.int64), seg.view(np.int64), lo - base, hi - base, apos - base


def _find_segments(limit: int):
    def run(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            data, starts = A.text_bytes(batch.column("text"))
            for i, j in A.chunks(starts):
                text, anchor, seg, lo, hi, apos = segments(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], limit)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, seg, rows[i + text], lo, hi, apos)], names=["anchor", "seg", "row", "lo", "hi", "apos"])

    return run


def repeated_starts(bodies: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the body, offset) of every string of ``limit`` bytes that starts at two places of the bodies."""
    m = len(bodies)
    size = np.array([len(b) + 1 for b in bodies])
    begin = np.cumsum(size) - size
    n = int(size.sum())
    stop = begin + size - 1
    base = 1 << (min(START, limit).bit_length() - 1)
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + m
    text[stop] = np.arange(m)  # one terminator each, below all bytes
    rank, step, early = text, 1, None
    while True:  # ranks by the first 2 * step symbols
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + m + 258) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        step *= 2
        if step == base:
            early = rank
        if fresh.all() or step >= max(size.max(), base):
            early = rank if early is None else early
            break
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    following, previous = np.full(n, n), np.full(n, -1)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    inner = bwt >= m

    known = np.ones(n + 1, bool)
    starts = early[order]
    known[1:n] = starts[1:] != starts[:-1]
    lower = np.flatnonzero(known[:n])
    upper = np.concatenate((lower[1:], [n])) - 1
    for _ in range(min(base, step), limit):  # prefixes one byte longer each time
        at = A.ragged(lower, upper - lower + 1)
        top, bottom = np.repeat(lower, upper - lower + 1), np.repeat(upper, upper - lower + 1)
        ok = inner[at]
        opens = np.sort(lf[at[ok & (previous[at] < top)]])
        closes = np.sort(lf[at[ok & (following[at] > bottom)]])
        new = ~known[closes + 1]
        lower, upper = opens[new], closes[new]
        known[upper + 1] = True
        if not len(lower):
            break
    shared = ~known
    place = np.sort(order[shared[:n] | shared[1:]])
    body = np.searchsorted(begin, place, "right") - 1
    return body, place - begin[body]


def _expand(limit: int):
    """Repeated ranges of segments whose anchors follow each other in order."""

    def ranges(group):
        body, offset = repeated_starts([g[3] for g in group], limit)
        if not len(body):
            return None
        first = np.flatnonzero(np.concatenate(([True], (body[1:] != body[:-1]) | (offset[1:] != offset[:-1] + 1))))
        last = np.concatenate((first[1:], [len(body)])) - 1
        rows = np.array([g[1] for g in group])[body[first]]
        lo = np.array([g[2] for g in group])[body[first]]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(lo + offset[first]), pa.array(lo + offset[last] + limit)], names=["row", "start", "end"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "lo", "body")), strict=True):
                if size >= BATCH and item[0] != held[-1][0]:
                    if (out := ranges(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(item)
                size += len(item[3])
        if held and (out := ranges(held)) is not None:
            yield out

    return run


def _cut(limit: int):
    """The bytes of the listed segments of each text."""

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            out = []
            for text, row, wanted in zip(texts, batch.column("row").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                out.extend((w["anchor"], w["seg"], row, w["lo"], w["hi"], w["apos"], text[w["lo"] : w["hi"] + limit]) for w in wanted)
            yield _rows(out)

    return run


def _rows(out):
    kinds = [pa.int64()] * 6 + [pa.binary()]
    columns = list(zip(*out, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "seg", "row", "lo", "hi", "apos", "body"])


def _digest(*parts) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p if isinstance(p, bytes) else int(p).to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little", signed=True)


def _halve(limit: int, cell: int):
    """Cut segments into cells of ``cell`` distances to the anchor; the bytes that all windows of a cell cover join the key."""

    def run(batches):
        for batch in batches:
            out = []
            for anchor, _, row, lo, hi, apos, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range((apos - hi) // cell, (apos - lo) // cell + 1):
                    a, b = max(lo, apos - (k + 1) * cell + 1), min(hi, apos - k * cell)
                    core_from, core_to = apos - k * cell, apos - (k + 1) * cell + 1 + limit
                    out.append((_digest(anchor, k, body[core_from - lo : core_to - lo]), _digest(apos - a, body[a - lo : b - lo + limit]), row, a, b, apos, body[a - lo : b - lo + limit]))
            yield _rows(out)

    return run


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: a 64-bit hash of id and text; rows equal in both share one and are still counted twice."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def repeats(docs: DataFrame, limit: int = 200, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(row, start, end): byte ranges covered by repeated strings, possibly overlapping; ``row`` as in row_key, or ``key`` where one is given.

    What each round finds is written before the next one, so a plan holds one round and a lost executor costs one.
    """
    row = row_key(id_col, text_col) if key is None else key
    texts = docs.select(row.alias("row"), F.col(text_col).alias("text")).where(F.octet_length("text") >= limit)
    found = texts.mapInArrow(A.tidy(_find_segments(limit)), SEGMENTS)
    anchors = written(found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("s0"), F.max("seg").alias("s1")).where("n > 1").select("anchor", F.expr("s0 = s1").alias("uniform")))
    again = written(found.join(anchors, "anchor"))
    span = ["row", F.col("lo").alias("start"), (F.col("hi") + limit).alias("end")]

    kinds = written(
        again.where("not uniform").groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo", "hi", "apos")).alias("one"))
        .select("anchor", "seg", "c", "one.*")
    )
    twice = kinds.where("c > 1").select("anchor", "seg")
    covered = [again.where("uniform").select(*span), written(again.where("not uniform").join(twice, ["anchor", "seg"], "left_semi").select(*span))]
    wanted = kinds.groupBy("row").agg(F.collect_list(F.struct("anchor", "seg", "lo", "hi", "apos")).alias("wanted"))
    wanted_filter = A.IdFilter.of(kinds.select("row").distinct(), "row")
    near = texts.withColumn("slot", A.IdFilter.slot_column("row")).mapInArrow(A.tidy(_maybe(wanted_filter, ["row", "text"])), "row long, text string")
    rows = written(near.join(wanted, "row").mapInArrow(A.tidy(_cut(limit)), f"{SEGMENTS}, body binary"))
    release(docs.sparkSession)
    cell = limit - min(ANCHOR, limit) + 1
    while True:
        sizes = written(rows.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1"))
        small = rows.join(sizes.where(f"variants <= {GROUP}").select("anchor"), "anchor", "left_semi").select("anchor", "row", "lo", "body")
        covered.append(written(small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(A.tidy(_expand(limit)), "row long, start long, end long")))
        large = sizes.where(f"variants > {GROUP}").select("anchor")
        release(docs.sparkSession)
        if cell == 1 or large.isEmpty():
            break
        cell = -(-cell // 4)
        big = rows.join(large, "anchor", "left_semi").select("anchor", "seg", "row", "lo", "hi", "apos", "body")
        parts = written(big.mapInArrow(A.tidy(_halve(limit, cell)), f"{SEGMENTS}, body binary"))
        same = written(parts.groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo")).alias("one")))
        covered.append(written(parts.join(same.where("c > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select(*span)))
        rows = written(parts.join(same.select("anchor", "seg", F.col("one.row").alias("row"), F.col("one.lo").alias("lo")), ["anchor", "seg", "row", "lo"], "left_semi").select(*rows.columns))
    out = covered[0]
    for more in covered[1:]:
        out = out.unionByName(more)
    return out


def _maybe(wanted: A.IdFilter, names: list[str], keep: bool = True):
    def run(batches):
        for batch in batches:
            hit = wanted.maybe(batch.column("slot").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit if keep else ~hit)).select(names)

    return run


def _remove(as_text: bool):
    """Cut the spans out; what is left as bytes, or as text without the bytes of characters that a cut split."""

    def run(batches):
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            names = [c for c in batch.schema.names if c not in ("row", "spans")]
            kept, counts = [], []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, parts, at, runs, last = text or b"", [], 0, 0, -1
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if start > last:
                        runs += 1
                        parts.append(text[at:start])
                    at = last = max(last, end)
                parts.append(text[at:])
                kept.append(b"".join(parts))
                counts.append((len(text), len(text) - len(kept[-1]), runs))
            counts = np.array(counts, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())] + [pa.array(c) for c in counts], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"]
            )

    return run


def remove_repeats(docs: DataFrame, limit: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, text, kept (binary: the bytes left), n_bytes, n_removed, n_spans (maximal removed runs).

    With ``as_text`` kept is a string and lacks the bytes of characters that a cut split; the counts are those of the cut.

    Texts are UTF-8; null is empty; nothing matches across texts. Strings are judged on the input, so all occurrences go, the first included, and
    equal rows remove each other from ``limit`` bytes on. A cut may split a character. Null ids are allowed; other columns are not read.
    Rows are told apart by ``key`` (a long; by default row_key).
    """
    key = row_key(id_col, text_col) if key is None else key
    spans = written(repeats(docs, limit, id_col, text_col, key))
    each = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("row")).withColumn("slot", A.IdFilter.slot_column("row"))
    cut = A.IdFilter.of(spans.select("row").distinct(), "row")
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text string, row long"
    yes, no = (texts.mapInArrow(A.tidy(_maybe(cut, ["doc_id", "text", "row"], keep)), schema) for keep in (True, False))
    no = no.withColumn("spans", F.lit(None).cast("array<struct<start:long,end:long>>"))
    joined = yes.join(each, "row", "left").select("doc_id", "text", "row", "spans").union(no)
    return joined.mapInArrow(A.tidy(_remove(as_text)), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text string, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")


def without_repeats(docs: DataFrame, limit: int = 200) -> DataFrame:
    """``docs`` with texts that lack their repeated strings, all rows and columns kept; n_chars is brought up to date.

    Bytes of a character that a cut split go with it. A null text stays null. Every copy of a repeated string goes, the first one too, so
    rows equal in all columns lose their texts from ``limit`` bytes on. Columns may have any type.
    """
    names = docs.columns
    extra = [c for c in names if c not in ("doc_id", "text")]
    packed = docs.select(F.struct("doc_id", *extra).alias("doc_id"), "text")
    out = remove_repeats(packed, limit, as_text=True, key=row_key("doc_id.doc_id"))
    out = out.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))).select("doc_id.*", "text")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return out.select(*names)

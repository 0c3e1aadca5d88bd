"""Near copies by 64-bit SimHash: fingerprints meet at the anchor points of a covering code.

A half of a fingerprint is a word of 32 bits. The anchors are the words whose low 31 bits belong to the perfect Hamming code
[31, 26]: every word is within ``RADIUS`` = 1 of an anchor, its home. Two fingerprints that differ in at most 3 bits differ in at most
1 bit of one of their halves. A fingerprint is therefore replicated, for either half, to every anchor within the covering radius plus that
1 (17 at most), and whichever half has at most one difference, each of the two fingerprints visits the home of the other one.
At an anchor only its inhabitants are compared with its visitors.

Copies are one fingerprint before anything is replicated. At every anchor all visitors are first compared with up to three of its
inhabitants, which ties a dense group together at a cost linear in its size. Only visitors and inhabitants that are still in different
components are then compared with each other. No anchor is gathered in a task: these are joins on the anchor, whose large keys
adaptive execution splits. They are marked as merge joins: the planner tells the size of the visits by the bytes of the fingerprints
they are made from, or by those of a file in which they repeat, and would gather all of them in the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import arrays as A
from quirefold.llm.components import components
from quirefold.session import sized_side, written

SEED = 42
APART = 3
PIECE = 1 << 20
FLUSH = 1 << 16
SPACE = re.compile(rb"[\x20\x09-\x0d]")
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def shingle_hashes(text: bytes, width: int) -> Iterator[list[int]]:
    """XXH64 of all ``width``-word shingles of a text, repeats included, in lists of bounded length."""
    from xxhash import xxh64_intdigest

    kept, at, enough = [], 0, False
    while at < len(text):
        cut = SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = kept + text[at:end].lower().split()
        at = end
        if len(words) >= width:
            enough = True
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(size) - 1
            yield [xxh64_intdigest(line[i:j], SEED) for i, j in zip((ends - size + 1).tolist(), ends[width - 1 :].tolist(), strict=False)]
            kept = words[len(words) - width + 1 :]
        else:
            kept = words
    if kept and not enough:
        yield [xxh64_intdigest(b" ".join(kept), SEED)]


def fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes, owners, held = [], [], 0

    def flush() -> None:
        if owners:
            sizes = np.array([len(h) for h in hashes])
            bits = np.unpackbits(np.array([x for h in hashes for x in h], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
            np.add.at(ones, owners, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0))
            np.add.at(total, owners, sizes)

    for i, text in enumerate(texts):
        for part in shingle_hashes(text or b"", width):
            hashes.append(part)
            owners.append(i)
            held += len(part)
            if held >= FLUSH:
                flush()
                hashes, owners, held = [], [], 0
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _prints(width: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                prints = fingerprints(part.column("text").cast(pa.binary()).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def homes_and_visits(half: Column) -> Column:
    """The anchors within radius + 1 of a 32-bit word given as a long; the first is its home."""
    s = sum((F.bit_count(half.bitwiseAND(F.lit(mask))).cast("int") % 2) * (1 << k) for k, mask in enumerate(CHECKS))

    def turned(word: Column, place: Column) -> Column:
        return word.bitwiseXOR(F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)).otherwise(F.lit(0).cast("long")))

    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i < i.bitwiseXOR(s))
    home = turned(half, s)
    far = F.transform(pairs, lambda i: turned(turned(half, i), i.bitwiseXOR(s)))
    return F.concat(F.array(home, home.bitwiseXOR(F.lit(1 << 31))), far)


def _near(a: str, b: str) -> Column:
    return F.expr(f"bit_count({a} ^ {b}) <= {APART}")


def anchored(prints: DataFrame) -> DataFrame:
    """(anchor, print, home) for every distinct fingerprint and either half."""
    low, high = F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)), F.expr("shiftrightunsigned(print, 32)")
    rows = None
    for half, word in enumerate((low, high)):
        at = prints.select("print", word.alias("word")).select("print", F.posexplode(homes_and_visits(F.col("word"))).alias("no", "anchor"))
        at = at.select((F.col("anchor") + F.lit(half << 32)).alias("anchor"), "print", (F.col("no") == 0).alias("home"))
        rows = at if rows is None else rows.union(at)
    return rows


def link_prints(prints: DataFrame) -> DataFrame:
    """(print, component) of the distinct fingerprints in ``prints`` that are linked with another one."""
    visits = anchored(prints)
    homes = visits.where("home").groupBy("anchor").agg(F.min("print").alias("l0"), F.max("print").alias("l1"), F.min_by("print", F.xxhash64("print")).alias("l2"))
    members = written(visits.join(homes.hint("merge"), "anchor").where("l0 <> l1 or l0 <> print"))
    leaders = F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("lead")
    first = members.select("print", leaders).where("print <> lead").where(_near("print", "lead")).select(F.col("print").alias("a"), F.col("lead").alias("b"))
    tied = written(components(first))
    placed = (
        members.select("anchor", "print", "home")
        .join(tied.select(F.col("node").alias("print"), "component"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    )
    mixed = placed.groupBy("anchor").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("anchor")
    still = written(placed.join(mixed, "anchor", "left_semi"))
    x, y = still.where("home").alias("x"), still.hint("merge").alias("y")
    across = (
        x.join(y, F.expr("x.anchor = y.anchor")).where(F.expr("x.component <> y.component") & _near("x.print", "y.print"))
        .select(F.col("x.component").alias("a"), F.col("y.component").alias("b")).distinct()
    )
    whole = components(across).select(F.col("node").alias("old"), F.col("component").alias("new"))
    own = tied.select(F.col("node").alias("print"), F.col("component").alias("old"))
    own = own.union(whole.select(F.col("old"), F.col("old"))).distinct()
    return own.join(whole, "old", "left").select("print", F.coalesce("new", "old").alias("component"))


def link_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are runs of non-space characters with A-Z folded; a fingerprint's bit is set if over half of the hashes of all ``width``-word
    shingles, repeats included, have it. With fewer words the whole sequence is the one shingle; null, empty and blank texts have
    the fingerprint zero, which links like any other. Rows are linked when their fingerprints differ in at most ``APART`` bits, and
    component_id is the smallest id reachable by links. Equal rows and rows that share an id each come back, by their own text; rows
    with a null id link as others do, and component_id is null only if no row of the component has an id. Other columns of ``docs``
    are not read. No rows give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(A.tidy(_prints(width)), "doc_id long, print long"))
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    linked = written(link_prints(classes.select("print")))
    placed = classes.join(linked, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = written(placed.join(least, "component").select("print", "component_id"))
    return rows.join(sized_side(found), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

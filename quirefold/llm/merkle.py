"""A Merkle manifest of a table whose parents keep the hash state before every child slot.

A digest is 64 hexadecimal characters, just one block of SHA-256, so the state of a parent before each of its ``WIDTH`` children
is eight words that can be stored. A parent's row in the manifest holds these states beside its children. When a child is
replaced, folding takes the stored state of its slot, feeds the replacement and the siblings to its right, and goes
on with the result one level up; siblings to the left are not hashed again.

Leaves are numbered within their tree by a sort over range parts (counts of the parts are carried, rows are not), and
``BLOCK`` = ``WIDTH`` ^ ``HEIGHT`` neighbours form one group: a task builds, or folds, ``HEIGHT`` levels of one group at a time. The roots of the
groups are the nodes of the next round, and the roots of all trees, in the order of their names, are the leaves of a last tree.
Whatever the table's size, no group has more than ``BLOCK`` rows and the driver gets none of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import written

WIDTH = 8
HEIGHT = 4
BLOCK = WIDTH**HEIGHT
HEX = 64
TOP = "top"
PATH = "array<struct<slot int, state binary, siblings binary>>"


def _root_bits(degree: int, count: int) -> np.ndarray:
    """The first 32 bits behind the point of the ``degree``-th roots of the first primes."""
    primes = [p for p in range(2, 320) if all(p % q for q in range(2, int(p**0.5) + 1))][:count]
    out = []
    for p in primes:
        low, high = 0, p << 32
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if mid**degree <= p << 32 * degree else (low, mid)
        out.append(low & 0xFFFFFFFF)
    return np.array(out, np.uint32)


START, ROUND = _root_bits(2, 8), _root_bits(3, 64)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256's step for many states (n, 8) and as many blocks of 64 bytes (n, 64)."""
    w = list(np.ascontiguousarray(block).view(">u4").astype(np.uint32).T)
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + w[i - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + t, c, b, a, t + u
    return state + np.stack((a, b, c, d, e, f, g, h), 1)


def _finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Hex digests (n, 64) once all ``children`` blocks are in."""
    tail = np.zeros((len(state), 64), np.uint8)
    tail[:, 0] = 0x80
    tail[:, 56:] = (children.astype(np.int64) * HEX * 8).astype(">i8").view(np.uint8).reshape(-1, 8)
    raw = compress(state, tail).astype(">u4").view(np.uint8).reshape(-1, 32)
    return np.frombuffer(b"0123456789abcdef", np.uint8)[np.stack((raw >> 4, raw & 15), 2).reshape(-1, HEX)]


def parents(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of children (n, 64): the states before each slot (parents, 8, 8), and the parents' digests."""
    count = -(-len(nodes) // WIDTH)
    sizes = np.minimum(WIDTH, len(nodes) - WIDTH * np.arange(count))
    states = np.zeros((count, WIDTH, 8), np.uint32)
    state = np.tile(START, (count, 1))
    for slot in range(WIDTH):
        states[:, slot] = state
        full = slice(0, count if slot < sizes[-1] else count - 1)
        state[full] = compress(state[full], nodes[slot::WIDTH])
    return states, _finish(state, sizes)


def resume(state: np.ndarray, own: np.ndarray, right: np.ndarray, more: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of parents whose ``own`` child is replaced: from the stored state on, with the ``more`` siblings to its right (n, 7, 64)."""
    state = compress(state, own)
    for k in range(WIDTH - 1):
        at = np.flatnonzero(more > k)
        if not len(at):
            break
        state[at] = compress(state[at], right[at, k])
    return _finish(state, children)


def _digests(column: pa.Array) -> np.ndarray:
    data = "".join(column.to_pylist()).encode()
    return np.frombuffer(data, np.uint8).reshape(-1, HEX)


def _texts(nodes: np.ndarray) -> list[str]:
    return np.ascontiguousarray(nodes).view(f"S{HEX}").ravel().astype(str).tolist()


def _levels(total: int) -> int:
    """Levels that a group of a tree with ``total`` nodes in this round has below its root."""
    levels = 0
    while total > 1 and levels < HEIGHT:
        total, levels = -(-total // WIDTH), levels + 1
    return levels


GROUP = "tree string, idx long, digest string, nodes array<binary>, states array<binary>"


def _build(table: pa.Table) -> pa.Table:
    """One group of at most ``BLOCK`` nodes: its root, and for every level below it the nodes and the states of their parents."""
    table = table.sort_by("idx")
    at = _digests(table["digest"])
    nodes, states = [], []
    for _ in range(_levels(table["total"][0].as_py())):
        kept, up = parents(at)
        nodes.append(at.tobytes())
        states.append(kept.tobytes())
        at = up
    return pa.Table.from_arrays(
        [pa.array([table["tree"][0].as_py()]), pa.array([table["idx"][0].as_py() // BLOCK], pa.int64()), pa.array(_texts(at)), pa.array([nodes], pa.list_(pa.binary())), pa.array([states], pa.list_(pa.binary()))],
        names=["tree", "idx", "digest", "nodes", "states"],
    )


def _number(batches):
    """A running number per tree within a sorted part; the part's own number goes with it."""
    seen, tree = 0, None
    for batch in batches:
        names, out = batch.column("tree").to_pylist(), np.zeros(batch.num_rows, np.int64)
        for i, name in enumerate(names):
            seen, tree = (seen + 1, tree) if name == tree else (0, name)
            out[i] = seen
        part = pa.array(np.full(batch.num_rows, TaskContext.get().partitionId()))
        yield pa.RecordBatch.from_arrays([*batch.columns, part, pa.array(out)], names=[*batch.schema.names, "part", "no"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with idx, their place in their ``tree`` by ``order`` (nulls first), and total, the tree's size; a written table.

    Rows equal in all of ``order`` are told apart by their place in the input, so that repeated rows do not meet in one part.
    """
    keys = ["tree", *order, "place"]
    placed = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = written(placed.mapInArrow(_number, f"{kinds}, part long, no long"))
    sizes = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tree", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return placed.join(offsets, ["tree", "part"]).select(*rows.columns, (F.col("ahead") + F.col("no")).alias("idx"), "total")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The written groups of every round, from nodes (tree, idx, total, digest) up to one group for each tree."""
    rounds = []
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        groups = nodes.select("tree", "idx", "total", "digest").groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block"))
        rounds.append(written(groups.applyInArrow(_build, GROUP)))
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds
        totals = rounds[-1].groupBy("tree").agg(F.count("*").alias("total"))
        nodes = rounds[-1].select("tree", "idx", "digest").join(totals, "tree")


def _steps(nodes: list[bytes], states: list[bytes], at: int) -> list[dict]:
    """The way of node ``at`` of a group to the group's root."""
    out = []
    for children, kept in zip(nodes, states, strict=True):
        first = at // WIDTH * WIDTH
        run = children[first * HEX : (first + WIDTH) * HEX]
        slot = at - first
        out.append({"slot": slot, "state": kept[at * 32 : at * 32 + 32], "siblings": run[: slot * HEX] + run[(slot + 1) * HEX :]})
        at //= WIDTH
    return out


def _ways(batches):
    """From groups with the way of their root (path): the way of each of their nodes."""
    for batch in batches:
        for row in batch.to_pylist():
            size = len(row["nodes"][0]) // HEX if row["nodes"] else 1
            paths = [_steps(row["nodes"], row["states"], i) + (row["path"] or []) for i in range(size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * size), pa.array(np.arange(size) + row["idx"] * BLOCK), pa.array(paths, pa.list_(pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())]))), pa.array([row["subroot"]] * size), pa.array([row["root"]] * size)],
                names=["tree", "idx", "path", "subroot", "root"],
            )


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, idx, path, subroot, root) of the first round's groups, from those of each tree's root."""
    for groups in reversed(rounds[1:]):
        above = groups.join(above, ["tree", "idx"]).mapInArrow(_ways, f"tree string, idx long, path {PATH}, subroot string, root string")
    return above


@dataclass
class Manifest:
    """leaves (all given columns with tree, idx, total, leaf), groups (parents with their states), paths (of each group's root to the root)."""

    leaves: DataFrame
    groups: DataFrame
    paths: DataFrame


def leaf(*columns: Column | str) -> Column:
    """The digest of a row: each value as its length in UTF-8 bytes, a colon and itself, a null as a hyphen."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def build(rows: DataFrame, group: str, order: str) -> Manifest:
    """The manifest of ``rows``, which have a ``leaf`` digest: a tree for each value of ``group`` (null is one), leaves by ``order``.

    Rows that tie in ``order`` follow each other by their leaf, a null comes first, and no rows give empty tables. ``tree``, ``idx`` and
    ``total`` are added to the columns of ``rows``, which may not have such columns.
    """
    rows = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    leaves = numbered(rows, order, "leaf")
    own = _rounds(leaves.withColumnRenamed("leaf", "digest"))
    subroots = own[-1].select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    trees = written(numbered(subroots, "name"))
    top = _rounds(trees)
    root = top[-1].select("tree", "idx", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = _descend([None, *top], root)
    above = trees.join(over.select("idx", "path", "root"), "idx").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root")
    return Manifest(leaves, own[0], written(_descend(own, above)))


def _fold(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of one group with their proofs, and with the root that follows when each row's leaf alone is replaced."""
    del key
    kept = left.drop_columns(["tree", "block", "replaced"])
    group = right.to_pylist()[0]
    places = left["idx"].to_numpy() % BLOCK
    at, now = places, _digests(left["replaced"])
    proofs = [[] for _ in places]
    for children, states in zip(group["nodes"], group["states"], strict=True):
        nodes = np.frombuffer(children, np.uint8).reshape(-1, HEX)
        first = at // WIDTH * WIDTH
        size = np.minimum(WIDTH, len(nodes) - first)
        slot = at - first
        padded = np.concatenate((nodes, np.zeros((WIDTH, HEX), np.uint8)))
        right_of = padded[np.minimum(at[:, None] + 1 + np.arange(WIDTH - 1), len(padded) - 1)]
        now = resume(np.frombuffer(states, np.uint32).reshape(-1, 8)[at], now, right_of, size - slot - 1, size)
        for k, i in enumerate(at.tolist()):
            run = i // WIDTH * WIDTH
            proofs[k] += [children[run * HEX : i * HEX], children[(i + 1) * HEX : (run + WIDTH) * HEX]]
        at = at // WIDTH
    distinct, back = np.unique(np.ascontiguousarray(now).view(f"S{HEX}").ravel(), return_inverse=True)
    now = distinct.view(np.uint8).reshape(-1, HEX)
    rest = []
    for step in group["path"] or []:
        slot, others = step["slot"], len(step["siblings"]) // HEX
        after = np.frombuffer(step["siblings"], np.uint8).reshape(-1, HEX)[slot:]
        n = len(now)
        filled = np.zeros((n, WIDTH - 1, HEX), np.uint8)
        filled[:, : len(after)] = after
        now = resume(np.tile(np.frombuffer(step["state"], np.uint32), (n, 1)), now, filled, np.full(n, len(after)), np.full(n, others + 1))
        rest.append(step["siblings"])
    tail = b"".join(rest)
    digests = [hashlib.sha256(b"".join(p) + tail).hexdigest() for p in proofs]
    folded = np.array(_texts(now), object)[back.ravel()].tolist()
    n = left.num_rows
    out = [pa.array([group["subroot"]] * n, pa.string()), pa.array([group["root"]] * n, pa.string()), pa.array(digests, pa.string()), pa.array(folded, pa.string())]
    for name, column in zip(("subroot", "root", "proof_sha256", "folded_root"), out, strict=True):
        kept = kept.append_column(name, column)
    return kept


def fold(manifest: Manifest, replaced: Column | str) -> DataFrame:
    """The manifest's rows with subroot, root, proof_sha256 (of all siblings, from the leaf to the root) and folded_root.

    folded_root is the root that follows when the row's own leaf is ``replaced`` (a null: its own leaf) and everything else is as in
    the manifest; it equals root just when the row is as it was.
    """
    rows = manifest.leaves.withColumn("replaced", F.coalesce(F.col(replaced) if isinstance(replaced, str) else replaced, "leaf")).withColumn("block", F.expr(f"idx div {BLOCK}"))
    groups = manifest.groups.drop("digest").join(manifest.paths, ["tree", "idx"]).withColumnRenamed("idx", "block")
    names = [f for f in rows.schema.fields if f.name not in ("tree", "block", "replaced")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    both = rows.groupBy("tree", "block").cogroup(groups.groupBy("tree", "block"))
    return both.applyInArrow(_fold, f"{kinds}, subroot string, root string, proof_sha256 string, folded_root string")

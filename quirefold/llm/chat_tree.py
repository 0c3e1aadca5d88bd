"""Chat formatting as a prefix tree: turns that conversations share from their start are written once.

A node is a turn together with all turns before it; its key is a running 128-bit hash, so conversations with equal beginnings have equal keys and
a hot first turn is one node after a partial aggregation. Conversations are ranked by their lists of keys (a range sort); a node stands at the
smallest rank of its conversations, then by depth, which is the depth-first order of the tree. The stream holds each node's tokens once, at
``start``; ``position`` counts the tokens of its ancestors, and ``attends`` lists the stream intervals of the ancestors
(merged where they touch). A token attends to those intervals and to its own node up to itself.

A turn is ``<|im_start|>role\\n``, the text and ``<|im_end|>\\n``, each encoded for itself, so the loss mask is the token range of the text. Inside
texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; line breaks of a role become ``\\n``; reading undoes this.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.token_store import tokenizer
from quirefold.session import written

START, END = "<|im_start|>", "<|im_end|>"
KEY = ["k1", "k2", "depth"]
IDS = "head array<int>, body array<int>, tail array<int>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, str, str]:
    name = escape(role).replace("\n", "\\n")
    return f"{START}{name}\n", escape(text), f"{END}\n"


def parse(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    name, _, rest = turn.removeprefix(START).partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name, flags=re.S)
    return role, unescape(rest.removesuffix(f"{END}\n"))


def _encode(path: str):
    def run(batches):
        model = tokenizer(path)[0]
        for batch in batches:
            parts = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            ids = [[e.ids for e in model.encode_batch([p[k] for p in parts], add_special_tokens=False)] for k in range(3)]
            names = [n for n in batch.schema.names if n not in ("role", "text")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(x, pa.list_(pa.int32())) for x in ids], names=[*names, "head", "body", "tail"])

    return run


def _lineage(batches):
    """Positions and ancestor intervals along each conversation; rows come by conversation and depth."""
    conv, runs, position = None, [], 0
    for batch in batches:
        out = []
        for c, k1, k2, depth, start, n, owner in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if c != conv:
                conv, runs, position = c, [], 0
            if owner:
                out.append((k1, k2, depth, position, [{"from": a, "to": b} for a, b in runs]))
            if runs and runs[-1][1] == start:
                runs[-1] = (runs[-1][0], start + n)
            else:
                runs.append((start, start + n))
            position += n
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[*KEY, "position", "attends"])


def build(conversations: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(tree, turns): the stream, one row per node, and the node of every turn of every conversation.

    tree: k1, k2, depth, start, n_tokens, position, attends, head, body, tail, loss (whether the body is under the loss mask). turns: conv_id, depth, k1, k2. Null
    roles and texts are empty; rows of one turn number follow by role and text, repeated rows are turns of their own; rows
    without a conversation are left out. A conversation is folded in one task, over keys and lengths only.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(order))
    path_so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k, salt in (("k1", 1), ("k2", 2)):
        rows = rows.withColumn(k, F.bit_xor(F.xxhash64(F.lit(salt), "depth", "role", "text")).over(path_so_far))
    rows = written(rows)
    paths = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "k1", "k2"))), lambda s: F.struct(s["k1"], s["k2"])).alias("path"))
    ranked = written(paths.orderBy("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("rank")))
    turns = rows.select("conv_id", *KEY).join(ranked, "conv_id")
    owners = turns.groupBy(*KEY).agg(F.min("rank").alias("rank"))
    first = owners.join(ranked, "rank").select(*KEY, "conv_id", "rank")  # the conversation whose row tells the node's text
    nodes = rows.join(first, ["conv_id", *KEY]).select(*KEY, "rank", (F.col("role") == "assistant").alias("loss"), "role", "text")
    coded = nodes.mapInArrow(_encode(path), f"k1 long, k2 long, depth int, rank long, loss boolean, {IDS}")
    coded = written(coded.withColumn("n_tokens", (F.size("head") + F.size("body") + F.size("tail")).cast("long")).withColumn("part", F.shiftright("rank", 33)))
    parts = coded.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per range of the sort
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("rank", "depth")) - F.col("n_tokens")
    placed = written(coded.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("inside")).drop("part", "base", "inside"))
    steps = turns.join(placed.select(*KEY, "start", "n_tokens", F.col("rank").alias("owner")), KEY)
    steps = steps.select("conv_id", *KEY, "start", "n_tokens", (F.col("rank") == F.col("owner")).alias("mine")).repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    lineage = steps.mapInArrow(_lineage, "k1 long, k2 long, depth int, position long, attends array<struct<from:long,to:long>>")
    tree = written(placed.drop("rank").join(lineage, KEY).repartitionByRange("start").sortWithinPartitions("start"))
    return tree, rows.select("conv_id", *KEY)


def _digests(path: str):
    """Decode the turns of each conversation, in order, and digest what they say."""

    def run(batches):
        model, conv, state = tokenizer(path)[0], None, None

        def close():
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "head", "body", "tail", "loss"))
            for c, head, body, tail, loss in zip(*columns, strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(close())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turn = model.decode(head + body + tail, skip_special_tokens=False)
                role, text = parse(turn)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(turn)
                if loss:
                    masked = unescape(model.decode(body, skip_special_tokens=False))
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            yield _table(out)
        if state is not None:
            yield _table([close()])

    return run


def _table(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(tree: DataFrame, turns: DataFrame, path: str) -> DataFrame:
    """Per conversation what its path through the tree says: turns and loss text, digested from the decoded tokens."""
    rows = turns.join(tree.select(*KEY, "head", "body", "tail", "loss"), KEY).select("conv_id", "depth", "head", "body", "tail", "loss")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return rows.mapInArrow(_digests(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

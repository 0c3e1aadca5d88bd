import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import merkle
from quirefold.llm.queries import op13_merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at):
    """The root above ``nodes`` and the siblings of node ``at``, level by level."""
    siblings = ""
    while len(nodes) > 1:
        run = at // 8 * 8
        siblings += "".join(nodes[run:at] + nodes[at + 1 : run + 8])
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return nodes[0], siblings


def low(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    leaves = {n: [leaf_of(r) for r in trees[n]] for n in names}
    subs = [climb(leaves[n], 0)[0] for n in names]
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(trees[n]):
            sub, low_path = climb(leaves[n], i)
            root, high = climb(subs, k)
            tampered = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else (*r[:4], low(r[4]))
            changed = leaves[n][:i] + [leaf_of(tampered)] + leaves[n][i + 1 :]
            folded = climb(subs[:k] + [climb(changed, 0)[0]] + subs[k + 1 :], 0)[0]
            out.append((r[0], leaves[n][i], sub, root, sha(low_path + high), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in op13_merkle(spark, str(tmp_path)).collect()), key=str)


def made(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["web", None]), rng.choice(["en", "en", "en", "fr", "é", None]), rng.choice([None, i]), rng.choice(["Ab Ç", "low", "", None, "X" * 3000])) for i in range(n)]


def test_equals_plain_trees(spark, tmp_path):
    rows = made(700, 1) + [(10**6, "a", "zz", 1, "Lone")] + [(None, None, None, None, None)] * 3 + [(5, "web", "en", 5, "Other")] * 2
    assert run(spark, rows, tmp_path) == brute(rows)


def test_one_leaf_is_the_root(spark, tmp_path):
    rows = [(3, "a", "en", 1, "One")]
    assert run(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("n", [8, 9, 65])
def test_edges_of_runs(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_no_rows(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_several_rounds_of_groups(spark):
    """More leaves than a group holds: the groups' roots are grouped again."""
    n = merkle.BLOCK * 2 + 5
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    manifest = merkle.build(rows, "lang", "doc_id")
    out = {r.doc_id: r for r in merkle.fold(manifest, F.when(F.col("doc_id") % 1000 == 0, F.sha2(F.lit("x"), 256))).collect()}
    leaves = [sha(str(i)) for i in range(n)]
    root = climb(leaves, 0)[0]
    for i in (0, 999, merkle.BLOCK, n - 1):
        changed = leaves[:i] + [sha("x") if i % 1000 == 0 else leaves[i]] + leaves[i + 1 :]
        assert (out[i].root, out[i].folded_root, out[i].proof_sha256) == (root, climb(changed, 0)[0], sha(climb(leaves, i)[1]))
    assert all((r.folded_root != r.root) == (i % 1000 == 0) for i, r in out.items()) and len(out) == n


def test_states_resume_hashing():
    rng = np.random.default_rng(0)
    nodes = np.frombuffer("".join(sha(str(i)) for i in range(13)).encode(), np.uint8).reshape(-1, 64)
    states, up = merkle.parents(nodes)
    assert merkle._texts(up) == [sha(nodes[:8].tobytes().decode()), sha(nodes[8:].tobytes().decode())]
    own = np.frombuffer(sha("new").encode(), np.uint8).reshape(1, 64)
    slot = int(rng.integers(0, 5))
    right = np.zeros((1, 7, 64), np.uint8)
    right[0, : 4 - slot] = nodes[8 + slot + 1 :]
    got = merkle.resume(states[1, slot][None], own, right, np.array([4 - slot]), np.array([5]))
    changed = [*merkle._texts(nodes[8 : 8 + slot]), sha("new"), *merkle._texts(nodes[8 + slot + 1 :])]
    assert merkle._texts(got) == [sha("".join(changed))]


def test_extra_columns(spark):
    rows = spark.createDataFrame([(1, "en", "a", 7), (2, None, "b", 8)], "doc_id long, lang string, text string, slot long").withColumn("leaf", merkle.leaf("text"))
    out = merkle.fold(merkle.build(rows, "lang", "doc_id"), F.lit(None).cast("string")).collect()
    assert sorted((r.doc_id, r.slot, r.root == r.folded_root) for r in out) == [(1, 7, True), (2, 8, True)]

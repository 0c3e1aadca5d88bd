import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quirefold.llm import components, simhash
from quirefold.session import written


def plain_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """prints: id -> fingerprint; the smallest id reachable."""
    ids, root = sorted(prints), {}
    for i in ids:
        if i in root:
            continue
        root[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in root and (prints[x] ^ prints[y]).bit_count() <= 3:
                    root[y] = i
                    todo.append(y)
    return root


def test_texts_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["é", "X", "", " ", "ß"]) + rng.choice("ijklmnop")
    texts = {}
    for i in range(0, 200, 4):
        words = [word() for _ in range(rng.randint(1, 120))]
        texts[i] = rng.choice([" ", "\t", " \n\x0b"]).join(words)
        texts[i + 1] = texts[i].upper() if i % 8 else texts[i]
        for k in (2, 3):
            changed = list(words)
            changed[rng.randrange(len(words))] = word()
            texts[i + k] = " ".join(changed)
    texts |= {900: "", 901: None, 902: " \t ", 903: "one", 904: "One", 905: "one two", 906: "a b c " * 40000}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("print", F.lit("clash"))
    out = {r.doc_id: r for r in simhash.link_components(docs).collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in out.items()} == prints and all(len(r.fingerprint) == 16 for r in out.values())
    assert {i: r.component_id for i, r in out.items()} == brute(prints)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abC") for _ in range(rng.randint(1, 9))) for _ in range(500))
    whole = simhash.fingerprints([text.encode()], 3)[0]
    monkeypatch.setattr(simhash, "PIECE", 40)
    monkeypatch.setattr(simhash, "FLUSH", 16)
    assert simhash.fingerprints([text.encode(), b"x" * 300, None], 3)[0] == whole == plain_print(text)


@pytest.mark.parametrize("spread", [1, 2, 4])
def test_dense_balls_of_fingerprints(spark, spread):
    """Hundreds of different fingerprints around a few centres: chains, dense groups and lone ones."""
    rng = random.Random(spread)
    prints = set()
    for centre in [0, (1 << 64) - 1, rng.getrandbits(64)]:
        for _ in range(300):
            p = centre
            for _ in range(rng.randint(0, spread) + rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    out = {r.print: r.component for r in simhash.link_prints(spark.createDataFrame([(s,) for s in signed], "print long")).collect()}
    found, least = brute({i: p for i, p in enumerate(signed.values())}), {}
    root = {s: found[i] for i, s in enumerate(signed)}
    for s, r in root.items():
        least[r] = min(s, least.get(r, s))
    assert {s: out.get(s, s) for s in signed} == {s: least[r] for s, r in root.items()}


def test_anchors_cover_and_meet(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        y = x
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
            y ^= 1 << b
        rows += [(i, 0, x - (1 << 64) if x >> 63 else x), (i, 1, y - (1 << 64) if y >> 63 else y)]
    prints = spark.createDataFrame(rows, "pair long, side int, print long")
    at = {}
    for r in simhash.anchored(prints.select("print")).collect():
        at.setdefault(r.print, (set(), set()))[r.home].add(r.anchor)
    for x, y in zip(rows[::2], rows[1::2], strict=True):
        assert at[x[2]][1] & (at[y[2]][0] | at[y[2]][1]) and at[y[2]][1] & (at[x[2]][0] | at[x[2]][1])
    for p, (far, home) in at.items():
        assert len(home) == 2 and 2 <= len(far) <= 32
        for a in far | home:
            word = p % (1 << 64) >> 32 if a >> 32 else p % (1 << 32)
            assert (word ^ a % (1 << 32)).bit_count() <= (1 if a in home else 2)


def test_visits_stay_out_of_the_driver(spark):
    """A small file of fingerprints makes many times as many visits; none of these tables is broadcast."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(12000)}
    prints |= {p ^ 1 << rng.randrange(64) for p in list(prints)[:3000]}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        out = simhash.link_prints(written(spark.createDataFrame(signed, "print long"))).groupBy("component").count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(out) == 3000 and {r["count"] for r in out} == {2}


def test_dense_anchors_stay_out_of_the_driver(spark, monkeypatch):
    """Where whole groups meet at an anchor, the planner takes a merge join on it: sizes of files say little of what they hold."""
    plans = []

    def seen(df, *by):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df, *by)

    def linked(edges):
        plans.append(edges._jdf.queryExecution().sparkPlan().toString())
        return components.components(edges)

    monkeypatch.setattr(simhash, "written", seen)
    monkeypatch.setattr(simhash, "components", linked)
    rng = random.Random(2)
    prints = {7 << 32 | rng.getrandbits(8) | rng.getrandbits(8) << 40 for _ in range(2000)}
    simhash.link_prints(written(spark.createDataFrame([(p,) for p in prints], "print long"))).collect()
    joins = re.findall(r"(\w+Join) \[anchor#\d+L\].*?, (Inner|LeftSemi)", "\n".join(plans))
    assert joins == [("SortMergeJoin", "Inner"), ("SortMergeJoin", "LeftSemi"), ("SortMergeJoin", "Inner")]


def test_null_and_shared_ids(spark):
    rows = [(None, "x y z"), (7, "x y z"), (7, "other words here now"), (None, "lonely text without id"), (3, "other words here now")]
    out = simhash.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted([(None, 7), (7, 7), (7, 3), (None, None), (3, 3)], key=str)
    assert simhash.link_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    names = list(range(400))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 300)] + [(5, 5), (None, 3)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(names[:151], min(names[:151])) | dict.fromkeys(names[200:300], min(names[200:300]))
    assert out == want

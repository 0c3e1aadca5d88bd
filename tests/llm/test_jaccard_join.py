import random
import re
from itertools import combinations

import numpy as np
import pytest

from quirefold.llm import jaccard_join as J


def brute(rows, width, num, den):
    sets, parent = {}, {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
        sets[i], parent[i] = grams, i

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both * den >= len(sets[a] | sets[b]) * num:
            u, v = sorted((find(a), find(b)))
            parent[v] = u
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        if rng.random() < 0.3:
            words = passage + words
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = word().upper()
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_same_as_brute_force(spark, width, num, den):
    rows = corpus(width, 300) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "é x"), (907, "É x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'z' as sig")
    got = sorted(tuple(r) for r in J.link_components(df, width, num, den).collect())
    assert got == brute(rows, width, num, den)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_signatures_meet_whatever_the_classes(monkeypatch, share):
    rng = np.random.default_rng(3)
    frequent = rng.random(J.BINS) < share
    monkeypatch.setattr(J, "SMALL_PAIRS", 4)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2**63, n, np.uint64))
        y = np.unique(np.concatenate((rng.permutation(x)[: len(x) - int(rng.integers(0, 1 + len(x) // 8))], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(x) // 8)), np.uint64))))
        both = len(np.intersect1d(x, y))
        if both * 5 >= (len(x) + len(y) - both) * 4 and len(x) > 1 and len(y) > 1 and not np.array_equal(x, y):
            assert len(np.intersect1d(J.signatures(x, frequent, 4, 5), J.signatures(y, frequent, 4, 5)))


def test_empty_and_odd_tables(spark):
    assert J.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in J.link_components(twice).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, None)]
    long = spark.createDataFrame([(1, "w " * 60000 + "x"), (2, "w " * 60000 + "x"), (3, "u")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.link_components(long).collect()} == {1: 1, 2: 1, 3: 3}
    assert J.keep_first(long).count() == 2


def test_bounds_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (300, 700, 5000):
        x = rng.integers(0, 2**63, n, np.uint64)
        y = np.concatenate((x[: n - n // 7], rng.integers(0, 2**63, n // 20, np.uint64)))
        maps = [J._long_parity(np.unique(v)) for v in (x, y)]
        apart = int(J._apart(*([m] for m in maps))[0])
        assert 0 < apart <= n // 7 + n // 20


@pytest.mark.parametrize(("rows", "passes"), [([(0, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")], 1), (corpus(5, 300), 2)])
def test_members_are_compared_again_only_where_a_group_stays_open(spark, monkeypatch, rows, passes):
    verify, calls = J.verify, []
    monkeypatch.setattr(J, "verify", lambda *args: calls.append(1) or verify(*args))
    got = J.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 4, 5)
    assert len(calls) == passes

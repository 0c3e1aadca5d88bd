import random
from collections import defaultdict

import pytest

from quirefold.llm import suffix_dedup as S


def brute(rows, limit):
    seen = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - limit + 1):
            seen[b[p : p + limit]].append((i, p))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + limit))
    out = []
    for (doc, t), g in zip(rows, gone, strict=True):
        b = (t or "").encode()
        out.append((doc, len(b), len(g), sum(x - 1 not in g for x in g), bytes(c for k, c in enumerate(b) if k not in g)))
    return sorted(out, key=repr)


def corpus(seed, n, limit):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcdé fgh\n") for _ in range(k))
    passages = [make(rng.randint(limit // 2, 3 * limit)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [make(rng.randint(0, 2 * limit))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            parts += [rng.choice(passages), make(rng.randint(0, limit))]
        rows.append((i, "".join(parts)))
    rows += [(n, rows[0][1]), (n, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, "aa" * 150), (None, make(90)), (n + 4, rows[1][1][3:-3])]
    return rows


@pytest.mark.parametrize(("limit", "group"), [(40, 48), (40, 3), (200, 48)])
def test_same_as_brute_force(spark, monkeypatch, limit, group):
    monkeypatch.setattr(S, "GROUP", group)
    rows = corpus(limit, 60, limit)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as spans")
    got = S.remove_repeats(docs, limit).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == brute(rows, limit)


def test_interval_expansion():
    rng = random.Random(1)
    for _ in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(80))
        bodies = [base[rng.randint(0, 20) : rng.randint(40, 80)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20))) for _ in range(6)]
        seen = defaultdict(list)
        for i, b in enumerate(bodies):
            for p in range(len(b) - 24):
                seen[b[p : p + 25]].append((i, p))
        want = sorted(x for v in seen.values() if len(v) > 1 for x in v)
        body, offset = S.repeated_starts(bodies, 25)
        assert list(zip(body.tolist(), offset.tolist(), strict=True)) == want


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0

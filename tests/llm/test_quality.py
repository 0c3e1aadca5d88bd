import random

import numpy as np
import pyarrow as pa

from quirefold.llm import quality as Q


def make(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words, kind = [word() for _ in range(rng.randint(5, 200))], rng.randrange(6)
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w for w in words[: len(words) // 8 + 1] for _ in range(8)]
        rows.append((i, " ".join(words), int(kind > 1)))
    return rows


def test_learns_and_scores_whole_texts(spark):
    rows = make(3, 500)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, ("good words " * 50 + "SHOUT!! " * 4000)), (901, None), (902, ""), (None, "x")], "doc_id long, text string").selectExpr("doc_id", "text", "'k' as score", "1 as y")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:400]] + [(None, 1), (955, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in Q.score_texts(docs, labels).collect()}
    assert len(got) == 504 and all(0 <= s <= 1 for s in got.values()) and got[901] == got[902]
    assert np.mean([(got[i] >= 0.7) == y for i, _, y in rows[400:]]) > 0.93
    assert got[900] < 0.5


def test_score_depends_on_the_text_alone():
    texts = [t for _, t, _ in make(5, 40)] + ["", "a", "é" * 3000]
    w = Q.fit(pa.array(texts), np.arange(len(texts)) % 2, 1)
    together = Q.scorer(w)(pa.array(texts))
    assert np.allclose(together, [Q.scorer(w)(pa.array([t]))[0] for t in texts], atol=1e-4)


def test_gradients_match_differences():
    w = {k: v.astype(np.float64) for k, v in Q.start_weights(2).items()}
    rng = np.random.default_rng(1)
    ids, y, weight = rng.integers(0, 256, (3, 512)), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = Q.chunk_probability(w, ids)[0]
        return -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    g = Q.gradients(w, ids, y, weight)
    for k, v in g.items():
        i = np.unravel_index(np.abs(v).argmax(), v.shape)
        w[k][i] += 1e-5
        up = loss()
        w[k][i] -= 2e-5
        down = loss()
        w[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - v[i]) < 1e-3, k


def test_one_class_or_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.score_texts(docs, none).collect())
    assert Q.score_texts(docs.limit(0), none).count() == 0


def test_forward_pass_as_plain_loops():
    """Every chunk, filter and byte one by one."""
    texts = ["", "a", "b" * 300, "some words " * 90, "é" * 700]
    w = Q.fit(pa.array(texts), np.array([0, 1, 0, 1, 1]), 1)
    got = Q.scorer(w)(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        data = list(text.encode())
        halves = -(-(len(data) + (Q.REACH - 1) * Q.STRIDE) // Q.HALF) if data else 0
        ids = data + [Q.PAD] * (halves * Q.HALF + Q.REACH * Q.STRIDE - len(data))
        peaks = []
        for h in range(halves):
            best = np.full(Q.FILTERS, -np.inf)
            for at in range(h * Q.HALF, (h + 1) * Q.HALF, Q.STRIDE):
                seen = np.concatenate([w["e"][b] for b in ids[at : at + Q.REACH * Q.STRIDE]])
                best = np.maximum(best, seen @ w["f"] if ids[at] != Q.PAD else 0)
            peaks.append(best)
        chunks = [np.maximum(a, b) for a, b in zip(peaks[:-1], peaks[1:], strict=True)] or peaks
        p = [1 / (1 + np.exp(-(np.maximum(c + w["c"], 0) @ w["o"] + w["b"][0]))) for c in chunks]
        assert abs(score - (np.mean(p) if p else 1 / (1 + np.exp(-w["b"][0])))) < 1e-4

import random

import numpy as np
import pyarrow as pa

from quirefold.llm import toxicity as T


def make(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(n):
        words, y = [word() for _ in range(rng.randint(5, 150))], int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Zzoof!", "zzoofing", "quirk"])
        rows.append((i, " ".join(words), y))
    return rows


def test_learns_and_scores_whole_texts(spark):
    rows = make(1, 500)
    rows.append((900, "plain " * 20000 + "zzoof quirk zzoofy", 1))  # evidence at the very end
    docs = spark.createDataFrame([r[:2] for r in rows] + [(950, None), (951, ""), (952, " "), (None, "x")], "doc_id long, text string").selectExpr("doc_id", "text", "'k' as score", "1 as y")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:400]] + [(rows[3][0], rows[3][2]), (None, 1), (953, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score_texts(docs, labels).collect()}
    assert len(got) == 505 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows[400:500]]) > 0.9
    assert got[900] >= 0.5 and got[950] == got[951] == got[952] < 0.5


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(T, "BUCKETS", 64)
    w = {k: v.astype(np.float64) for k, v in T.start_weights(3).items()}
    word, head = np.arange(30) % 7, np.arange(30) % 5
    first, length, y, weight = np.array([0, 9]), np.array([9, 4]), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    loss = lambda: -float((weight * (y * np.log(T.forward(w, word, head, first, length)) + (1 - y) * np.log(1 - T.forward(w, word, head, first, length)))).mean())
    p, kept = T.forward(w, word, head, first, length, True)
    g, _ = T.gradients(w, kept, p, y, weight)
    for k, v in g.items():
        i = (0,) * w[k].ndim
        w[k][i] += 1e-4
        up = loss()
        w[k][i] -= 2e-4
        down = loss()
        w[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - v[i]) < 1e-3, k


def test_windows_cover_all_words():
    first, length, text = T.windows(np.array([0, 0, 5, 125]))
    assert {t: set() for t in (1, 2)} == {t: set(range(*r)) - {x for f, n, u in zip(first, length, text, strict=True) if u == t for x in range(f, f + n)} for t, r in ((1, (0, 5)), (2, (5, 125)))}


def test_one_class_or_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 0.5 for r in T.score_texts(docs, none).collect())
    assert T.score_texts(docs.limit(0), none).count() == 0
    w = T.fit(pa.array(["", None, " "]), np.array([0, 1, 1]))
    assert np.isfinite(T.scorer(w)(pa.array(["x"]))).all()


def test_characters_of_the_whole_word():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    texts, labels = [], []
    for _ in range(600):
        words, y = [word() for _ in range(rng.randint(5, 60))], int(rng.random() < 0.3)
        if y:
            words[rng.randrange(len(words))] = word() + rng.choice(["zzoof", "quirk"]) + word()
        texts.append(" ".join(words))
        labels.append(y)
    score = T.scorer(T.fit(pa.array(texts[:500]), np.array(labels[:500])))
    assert np.mean((score(pa.array(texts[500:])) >= 0.5) == np.array(labels[500:])) > 0.9  # the words themselves are new
    run = "".join(word() for _ in range(40))
    assert list(score(pa.array([run, run[:120] + "zzoofquirk" + run[120:]])) >= 0.5) == [False, True]  # no spaces

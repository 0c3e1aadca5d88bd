import hashlib
import random
import re

from pyspark.sql import functions as F

from quirefold.llm import spotsigs as S


def sigs(text):
    ws = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate(ws):
        if w in S.ANCHORS:
            content = [x for x in ws[i + 1 : i + 9] if x not in S.ANCHORS][:2]
            if len(content) == 2:
                out.add((w, *content))
    return out or ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def corpus(n):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "und", "la"]) if rng.random() < 0.4 else "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5)))
    rows = []
    for i in range(n):
        rows.append((i * 3, ", ".join(word() for _ in range(rng.randint(0, 60)))))
        if i % 7 == 3:
            w = rows[rng.randrange(len(rows))][1].split(", ")
            w[rng.randrange(len(w))] = word()
            rows[-1] = (i * 3, ", ".join(w))
    return rows + [(1000, rows[2][1]), (1001, None), (1002, ""), (1003, "a"), (5, "the cat the dog sat on"), (5, "the cat the dog sat on")]


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 7)
    rows = corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as bucket", "2 as guest", "3 as at", "4 as next_text")
    got = S.compare_with_next(df.repartition(4)).collect()
    assert len(got) == len(rows)
    texts = [(i, t or "") for i, t in sorted(rows, key=lambda r: -r[0])]
    want = {}
    for k, (i, t) in enumerate(texts):
        other = texts[(k + 1) % len(texts)][1]
        third = len(t) // 3
        e = t[: len(t) - third] + other[:third]
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(sigs(t), sigs(e)), 9), round(jaccard(sigs(t), sigs(other)), 9))
    for r in got:
        if r.doc_id != 5:  # repeated rows: each is the other's next
            assert (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) == want[r.doc_id], r.doc_id
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[6] == prints[1000] and prints[1001] == prints[1002] and len(set(prints.values())) > 40
    assert "Python" not in S.compare_with_next(df)._jdf.queryExecution().toString()


def test_similar_finds_all_pairs(spark):
    rows = corpus(80)
    got = {(r.a, r.b) for r in S.similar(spark.createDataFrame(rows, "doc_id long, text string"), 0.6).collect()}
    first = {}
    for i, t in sorted(rows):
        if sigs(t):
            first.setdefault(frozenset(sigs(t)), i)
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and jaccard(a, b) >= 0.6}
    assert got == want and want


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "the cat sat down")], "doc_id long, text string")
    assert [(r.near_edited, r.near_next) for r in S.compare_with_next(df).collect()][0][1] == 1.0
    assert S.compare_with_next(df.where(F.lit(False))).count() == 0

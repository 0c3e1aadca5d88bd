import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.operators import cells, dense, lexical, lexical_index, store
from quirefold.plans.hybrid import hybrid_retrieve
from quirefold.sources import store as store_files
from quirefold.sources.store import CorpusStore


def texts(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, words))) for _ in range(n)]


def corpus(spark, rows):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "chunk_id long, doc_id long, text string")


def questions(spark, n, seed, words=8):
    return spark.createDataFrame(list(enumerate(texts(n, seed, words))), "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


def test_terms_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(1, "b-b a/A aa AA x Bb bb"), (2, ""), (3, None), (4, "é")], "chunk_id long, text string")
    got = {r.chunk_id: (r.length, [(t.term, t.tf) for t in r.terms]) for r in store.termed(docs).collect()}
    assert got == {1: (4, [("aa", 2), ("bb", 2)]), 2: (0, []), 3: (0, []), 4: (0, [])}


def test_bm25_equals_plain_sums(spark):
    docs = texts(150, 1)
    tokens = [t.split() for t in docs]
    n, mean = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(w for t in tokens for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = sum(raw.values()) / len(raw) * 0.25
    asked = texts(12, 2, 8)
    want = []
    for q, text in enumerate(asked):
        scores = {}
        for d, t in enumerate(tokens):
            tf = Counter(t)
            s = sum(k * (raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w, k in Counter(text.split()).items() if w in tf)
            scores[d] = round(s, 10)
        best = sorted(scores, key=lambda d: (-scores[d], d))[:20]
        want += [(q, r + 1, d, round(scores[d], 6)) for r, d in enumerate(best)]
    assert rows(lexical.bm25_topk(questions(spark, 12, 2), corpus(spark, docs))) == sorted(want)


@pytest.mark.parametrize("block", [4, 128])
def test_index_equals_scan(spark, block):
    docs, asked = corpus(spark, texts(1500, 3)), questions(spark, 30, 4)
    index = lexical_index.build_index(docs, block=block)
    got = rows(lexical_index.index_topk(asked, index, 5))
    assert got == rows(lexical.bm25_topk(asked, docs, 5)) and index.read["read"] < index.read["postings"]
    assert index.blocks.agg(F.max("n")).first()[0] == block
    held = sorted((r.term, c) for r in index.blocks.collect() for c in r.chunk_ids)
    assert held == sorted((r.term, r.chunk_id) for r in lexical.postings(docs).collect())


def test_index_in_shards(spark, monkeypatch):
    """Small shards, a text above a shard's bound, a null text; the build shuffles no posting."""
    shuffled = []
    docs, asked = corpus(spark, texts(400, 8)), questions(spark, 20, 9)
    odd = spark.createDataFrame([(899, 7, "w0 w1 w150"), (900, 900, " ".join(f"w{i}" for i in range(200))), (901, 901, None)], docs.schema)
    whole = docs.union(odd)
    write = lexical_index.written
    monkeypatch.setattr(lexical_index, "written", lambda df: (shuffled.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    index = lexical_index.build_index(whole, block=3, shard=50)
    assert not any("Exchange" in p and "chunk_ids" in p and "MapInArrow" in p for p in shuffled) and sum("MapInArrow" in p for p in shuffled) == 1
    assert index.blocks.agg(F.max("n")).first()[0] == 3 and index.blocks.where("term = 'w0'").count() > 50
    assert rows(lexical_index.index_topk(asked, index, 6)) == rows(lexical.bm25_topk(asked, whole, 6))
    assert sorted((r.term, r.n) for r in index.counts.collect()) == sorted((r.term, r.n) for r in lexical.corpus_counts(whole).collect())


def test_tasks_without_any_match(spark):
    docs = corpus(spark, ["zz yy"] * 20 + ["aa"]).repartition(8)
    asked = spark.createDataFrame([(1, "aa bb"), (2, "qq")], "query_id long, text string")
    got = rows(lexical.bm25_topk(asked, docs, 2))
    assert got == rows(lexical_index.index_topk(asked, lexical_index.build_index(docs), 2)) and [(q, c) for q, _, c, _ in got] == [(1, 20), (1, 0), (2, 0), (2, 1)]


def test_index_in_slices(spark, monkeypatch):
    docs, asked = corpus(spark, texts(300, 5)), questions(spark, 40, 6)
    whole = rows(lexical.bm25_topk(asked, docs, 4))
    monkeypatch.setattr(lexical, "MAX_QUERIES", 7)
    assert rows(lexical.bm25_topk(asked, docs, 4)) == whole == rows(lexical_index.index_topk(asked, lexical_index.build_index(docs), 4))


def test_index_of_odd_corpora(spark):
    tiny, asked = corpus(spark, ["aa bb", "aa"]), questions(spark, 3, 7)
    asked = asked.union(spark.createDataFrame([(9, "aa"), (10, ""), (11, None), (12, "zz")], "query_id long, text string"))
    assert rows(lexical_index.index_topk(asked, lexical_index.build_index(tiny), 2)) == rows(lexical.bm25_topk(asked, tiny, 2))
    none = corpus(spark, ["x"]).limit(0)
    assert rows(lexical_index.index_topk(asked, lexical_index.build_index(none), 2)) == []


def test_store_follows_replacements(spark, tmp_path):
    docs = texts(120, 8)
    held = CorpusStore(spark, str(tmp_path), 8).create(corpus(spark, docs))
    new = {3: "fresh words here", 50: texts(1, 9)[0], 500: "another new document", 7: ""}
    incoming = spark.createDataFrame([(i, i, t) for i, t in new.items()], "chunk_id long, doc_id long, text string")
    assert held.replace(incoming, spark.createDataFrame([(10,), (11,), (999,)], "doc_id long")) == 1
    now = {i: t for i, t in enumerate(docs) if i not in (10, 11)} | new
    full = spark.createDataFrame([(i, i, t) for i, t in now.items()], "chunk_id long, doc_id long, text string")
    stats = lambda counts: sorted((r.term, r.n) for r in counts.collect())
    assert stats(held.counts()) == stats(lexical.corpus_counts(full))
    assert sorted(r.chunk_id for r in held.chunks().collect()) == sorted(now)
    asked = questions(spark, 6, 10)
    hits = lambda r: sorted(tuple(h) for h in r.hits.collect())
    assert hits(hybrid_retrieve(asked, held.chunks(), counts=held.counts())) == hits(hybrid_retrieve(asked, full))
    assert sorted(r.chunk_id for r in held.chunks(0).collect()) == list(range(120)) and stats(held.counts(0)) == stats(lexical.corpus_counts(corpus(spark, docs)))


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_files, "TASK_ROWS", 5)
    docs = texts(80, 12)
    held = CorpusStore(spark, str(tmp_path), 2).create(corpus(spark, docs))
    assert all(len(list(p.glob("*.parquet"))) > 2 for p in (tmp_path / "chunks" / "version=0").glob("doc_bucket=*"))
    counts = lambda df: {r.term: r.n for r in df.collect()}
    assert counts(held.counts()) == counts(lexical.counted(corpus(spark, docs))) and held.chunks().count() == 80


def test_unfinished_version_is_not_seen(spark, tmp_path, monkeypatch):
    held = CorpusStore(spark, str(tmp_path), 4).create(corpus(spark, texts(30, 11)))
    with pytest.raises(ValueError):
        held.chunks(3)
    rows_of = lambda: sorted((r.chunk_id, r.length) for r in held.chunks().collect())
    before = rows_of()
    again = spark.createDataFrame([(1, 1, "new text")], "chunk_id long, doc_id long, text string")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr("quirefold.sources.store.changed_counts", dies)
        with pytest.raises(RuntimeError):
            held.replace(again)
    assert rows_of() == before and held.versions() == [0]
    held.replace(again)
    assert held.versions() == [0, 1] and dict(rows_of())[1] == 2
    held.replace(None, spark.createDataFrame([(1,)], "doc_id long"))
    assert 1 not in dict(rows_of())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_cells_equal_scan(spark, spread):
    """Clustered vectors, where cells are skipped, and spread ones, where they are not."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 800)] + spread * rng.standard_normal((800, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)] + [(9000, 0, None)], "chunk_id long, doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i * 7].tolist()) for i in range(15)], "query_id long, embedding array<double>")
    exact = rows(dense.dense_topk(asked, vectors.where("embedding is not null"), 10))
    index = cells.build_cells(vectors, 25)
    assert index.size.sum() == 800 and rows(cells.cell_topk(asked, index, 10)) == exact
    if spread < 0.1:
        assert index.read["scored"] < 0.5 * index.read["pairs"]
    near = {(q, c) for q, _, c, _ in rows(cells.cell_topk(asked, index, 10, share=0.5, exact=False, slice_rows=4))}
    assert len(near & {(q, c) for q, _, c, _ in exact}) >= 0.9 * len(exact)


def test_cells_of_nothing(spark):
    empty = spark.createDataFrame([], "chunk_id long, doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert cells.cell_topk(asked, cells.build_cells(empty)).collect() == []
    assert cells.cell_topk(asked.limit(0), cells.build_cells(spark.createDataFrame([(1, 1, [1.0, 0.0])], empty.schema))).collect() == []

import hashlib
import math
import random
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quirefold.functions import vectors as vec
from quirefold.functions.vectors import cosine01, embed_external, hash_embed, l2_normalize
from quirefold.operators import dense, fusion, lexical
from quirefold.plans.hybrid import hybrid_retrieve

WORDS = "heart failure dose apixaban renal stroke risk daily oral blood pressure kidney valve score".split()
POOL = WORDS + [f"rare{i}" for i in range(60)]


def corpus(spark, n=60, seed=5):
    rng = random.Random(seed)
    rows = [(i, i % 7, " ".join(rng.choice(POOL) for _ in range(rng.randint(3, 30)))) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, text string"), rows


def test_hash_embedding(spark):
    df = spark.createDataFrame([(0, "Dose of Dose"), (1, "  "), (2, "heart")], "i int, text string")
    got = [r["v"] for r in df.select("i", hash_embed(F.col("text")).alias("v")).orderBy("i").collect()]
    assert all(x == 0 for x in got[1])
    raw = [0.0] * 384
    for i, w in enumerate("dose of dose".split()):
        raw[int(hashlib.md5(w.encode()).hexdigest(), 16) % 384] += 1 + 1 / (i + 1)
        for j in range(len(w) - 2):
            raw[int(hashlib.sha256(w[j : j + 3].encode()).hexdigest(), 16) % 384] += 0.3
    norm = math.sqrt(sum(x * x for x in raw))
    assert max(abs(a - b / norm) for a, b in zip(got[0], raw)) < 1e-12
    assert abs(sum(x * x for x in got[2]) - 1) < 1e-9


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(l2_normalize(F.col("a")).alias("n"), cosine01(l2_normalize(F.col("a")), F.col("b")).alias("c")).collect()
    assert rows[0]["n"] == [0.6, 0.8] and rows[0]["c"] == 0.8
    assert rows[1]["n"] == [0.0, 0.0] and rows[1]["c"] == 0.5
    ext = embed_external(spark.createDataFrame([("ab",)], "t string"), "t", lambda ts: [[3.0, 4.0] for _ in ts]).first()
    assert ext["embedding"] == [0.6, 0.8]


def test_dense_grid_equals_broadcast_and_filter_holds(spark):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    c = spark.createDataFrame([(i, i % 5, vec()) for i in range(300)], "chunk_id long, doc_id long, embedding array<double>")
    c = c.withColumn("embedding", l2_normalize(F.col("embedding")))
    q = spark.createDataFrame([(i, vec()) for i in range(23)], "query_id long, embedding array<double>")
    q = q.withColumn("embedding", l2_normalize(F.col("embedding")))
    one = sorted(map(tuple, dense.dense_topk(q, c, 7).collect()))
    grid = sorted(map(tuple, dense.dense_topk(q, c, 7, max_queries=4, cell_rows=50).collect()))
    assert one == grid and len(one) == 23 * 7
    exact = c.crossJoin(q.withColumnRenamed("embedding", "e")).select("query_id", "chunk_id", cosine01(F.col("embedding"), F.col("e")).alias("s")).collect()
    best = {}
    for r in sorted(exact, key=lambda r: (-r["s"], r["chunk_id"])):
        best.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert all(best[q_][r - 1] == ch for q_, ch, _, r in one)
    allow = q.select("query_id", F.lit(3).cast("long").alias("doc_id"))
    assert {r["chunk_id"] % 5 for r in dense.dense_topk(q, c, 7, allow=allow).collect()} == {3}
    approx = dense.dense_topk_approx(q, c, 8, 7, bands=24, bits=2)
    assert dense.recall_of(approx, dense.dense_topk(q, c, 7)).agg(F.avg("recall")).first()[0] > 0.9
    assert dense.dense_topk(q, c.filter("chunk_id < 0"), 7).count() == 0
    assert dense.dense_topk(q, c.filter("chunk_id < 3"), 7).count() == 23 * 3


def test_filters_per_query_and_notes(spark):
    c, rows = corpus(spark)
    texts = ["heart dose dose", "stroke risk score", "renal kidney missing", "nothing shared"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    allow = spark.createDataFrame([(0, 1), (0, 1), (0, 3), (1, 2), (3, 4), (9, 1)], "query_id long, doc_id long")
    got = {}
    for r in lexical.bm25_topk(q, c, 8, allow=allow).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    seen = {0: {1, 3}, 1: {2}, 3: {4}}
    docs = {i: d for i, d, _ in rows}
    assert got == {i: [x for x in bm25_brute(rows, texts[i], 99) if docs[x] in seen[i]][:8] for i in seen}
    hits = hybrid_retrieve(q, c, document_filter=allow).hits.collect()
    plain = {(r["query_id"], r["chunk_id"], r["rank"]) for r in hybrid_retrieve(q, c).hits.collect()}
    assert all(docs[r["chunk_id"]] in seen[r["query_id"]] for r in hits if r["query_id"] in seen)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in hits if r["query_id"] == 2} == {x for x in plain if x[0] == 2}
    note = spark.createDataFrame([(900, 0, "stroke risk score"), (5, 0, "never, the corpus holds this id")], "chunk_id long, doc_id long, text string")
    with_note = hybrid_retrieve(q, c, notes=note).hits.filter("query_id = 1 and rank = 1").first()
    assert with_note["chunk_id"] == 900
    none = hybrid_retrieve(q, c, document_filter=allow.limit(0)).hits.collect()
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in none} == plain


def bm25_brute(rows, text, k):
    docs = {i: t.split() for i, _, t in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    scores = {}
    for i, d in docs.items():
        tf = Counter(d)
        scores[i] = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in text.split())
    ranked = sorted((-round(max(0, s), 10), i) for i, s in scores.items())[:k]
    return [i for _, i in ranked]


def test_bm25_matches_brute_force(spark):
    c, rows = corpus(spark)
    texts = ["heart dose dose", "stroke risk score", "renal kidney missing"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {}
    for r in lexical.bm25_topk(q, c, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {i: bm25_brute(rows, t, 10) for i, t in enumerate(texts)}


def test_overlap_stands_in_where_bm25_is_not_positive(spark):
    c = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "aa bb"), (1, "zz")], "query_id long, text string")
    got = lexical.bm25_topk(q, c, 5).collect()
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in got} == {(0, 1, 2.0), (0, 2, 1.0), (1, 1, 0.0), (1, 2, 0.0)}


def test_fusion_and_rerank_rules(spark):
    d = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    b = spark.createDataFrame([(0, 2, 12.0, 1), (0, 3, 3.0, 2)], "query_id long, chunk_id long, score double, rank int")
    fused = fusion.rrf_fuse(d, b)
    got = {r["chunk_id"]: r for r in fused.collect()}
    assert got[2]["rrf_score"] == 1 / 62 + 1 / 61 and got[1]["bm25_rank"] == 999 and got[3]["dense_score"] == 0
    many = {r["chunk_id"]: r["rrf_score"] for r in fusion.rrf_fuse_many([d, b]).collect()}
    assert all(abs(many[c] - got[c]["rrf_score"]) < 1e-12 for c in many)
    q = spark.createDataFrame([(0, "what is the heart dose")], "query_id long, text string")
    c = spark.createDataFrame([(1, "nothing shared"), (2, "heart dose"), (3, "the heart")], "chunk_id long, text string")
    hits = {r["chunk_id"]: r["rerank_score"] for r in fusion.rerank(fused, q, c).collect()}
    assert hits == {1: 0.225, 2: round(0.85 * 0.5 + 0.5, 4), 3: 0.5}
    gate = fusion.confidence_gate(fusion.rerank(fused, q, c), spark.createDataFrame([(0,), (9,)], "query_id long"), 0.75)
    assert {r["query_id"]: (r["best_score"], r["passed"]) for r in gate.collect()} == {0: (0.925, True), 9: (0.0, False)}


def test_hybrid_filter_and_partition_invariance(spark):
    c, _ = corpus(spark)
    q = spark.createDataFrame([(0, "heart dose"), (1, "kidney score")], "query_id long, text string")
    only = spark.createDataFrame([(2,)], "doc_id long")
    hits = hybrid_retrieve(q, c, document_filter=only).hits.collect()
    assert {r["chunk_id"] % 7 for r in hits} == {2}
    assert {r["rank"] for r in hits} == {1, 2, 3, 4, 5} and all(0 <= r["rerank_score"] <= 1 for r in hits)
    a = sorted(map(tuple, hybrid_retrieve(q, c.repartition(1)).hits.collect()))
    b = sorted(map(tuple, hybrid_retrieve(q, c.repartition(16)).hits.collect()))
    assert a == b


def test_candidate_pool_keeps_the_earlier_arm(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "chunk_id string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "chunk_id string, v int")
    assert {(r["chunk_id"], r["v"]) for r in fusion.candidate_pool(a, b, a).collect()} == {("x", 1), ("y", 1), ("z", 2)}


def test_vectors_can_be_counted_and_deleted(spark):
    v = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, chunk_id string")
    left = dense.delete_documents(v, spark.createDataFrame([(1,)], "doc_id long"))
    assert dense.index_count(left).first()[0] == 1


def test_lists_meet_chunks_and_not_their_terms(spark):
    """A scoped search shuffles chunks and lists; no row for each chunk, query and term (or vector) is made."""
    docs = spark.createDataFrame([(i, i, f"common words here own{i}") for i in range(40)], "chunk_id long, doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common words own{q}") for q in range(6)], "query_id long, text string")
    allow = docs.crossJoin(asked).where("(doc_id + query_id) % 3 = 0").select("query_id", "doc_id")
    found = lexical.bm25_topk(asked, docs, 4, allow=allow)
    assert "Generate inline(terms" not in found._jdf.queryExecution().optimizedPlan().toString()
    lists = {(r.query_id, r.doc_id) for r in allow.collect()}
    rows = found.collect()
    assert len(rows) == 24 and {(r.query_id, r.chunk_id) for r in rows} <= lists
    own = {r.query_id: r.chunk_id for r in rows if r["rank"] == 1}
    assert own[0] == 0 and own[3] == 3
    vectors = docs.select("chunk_id", "doc_id", F.array(F.lit(1.0), F.col("chunk_id").cast("double")).alias("embedding"))
    q = asked.select("query_id", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))
    near = dense.dense_topk(q, vectors, 4, allow=allow)
    assert near.count() == 24 and {(r.query_id, r.chunk_id) for r in near.collect()} <= lists


def test_scan_pieces_are_bounded_by_matches(monkeypatch):
    """A word that all queries and chunks share: what a task holds is bounded by matches, not by the batch."""
    monkeypatch.setattr(lexical, "MATCHES_AT_ONCE", 500)
    asked = lexical.QueryTerms(pd.DataFrame({"query_id": range(100), "terms": [[{"term": "a", "weight": 1.0}]] * 100}))
    batch = pa.RecordBatch.from_pylist([{"chunk_id": i, "length": 3, "terms": [{"term": "a", "tf": 1}]} for i in range(64)])
    parts = list(lexical.matches(asked, batch, lambda tf, length: tf))
    assert sum(p.num_rows for p, *_ in parts) == 64 and sum(len(q) for _, q, _, _ in parts) == 6400
    assert max(len(q) for _, q, _, _ in parts) <= 500


def test_embedding_holds_short_pieces_of_a_long_batch():
    texts = pa.array(["one two", None] * 1000)
    parts = list(vec._embed_pieces(iter([texts])))
    assert max(len(p) for p in parts) <= vec.PIECE < 2000 and sum(len(p) for p in parts) == 2000
    assert vec.MEMO_ENTRIES <= 100_000


def test_scoped_scores_without_a_whole_vector(spark):
    """As the engine's own arithmetic tells them: 1 where a vector or an entry is missing."""
    kind = "chunk_id long, doc_id long, embedding array<double>"
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 1, [float("nan"), 0.0]), (5, 2, [1.0, 0.0])], kind)
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, embedding array<double>")
    allow = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "query_id long, doc_id long")
    got = {(r.query_id, r.chunk_id): r.score for r in dense.dense_topk(asked, chunks, 9, allow=allow).collect()}
    pairs = chunks.join(allow.distinct(), "doc_id").join(asked.withColumnRenamed("embedding", "q"), "query_id")
    assert got == {(r.query_id, r.chunk_id): r.score for r in pairs.select("query_id", "chunk_id", cosine01(F.col("embedding"), F.col("q")).alias("score")).collect()}

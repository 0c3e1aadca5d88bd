import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import whitening
from quirefold.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """id -> (deviation, whitened up to signs), with the values: one dense covariance on one machine."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in ok])
    n, s = len(x), x.sum(0)
    gap = n * x - s
    values, vectors = np.linalg.eigh((gap / n).T @ (gap / n) / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return [i for i, _ in ok], (gap.astype(object) ** 2).sum(1), gap / n @ vectors / np.sqrt(values), values, float(((gap / n) ** 2).sum() / n)


def run(spark, rows, tmp_path):
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return op11_whitening(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("dims", [48, 20])
def test_equals_a_dense_decomposition(spark, tmp_path, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, (rng.standard_normal(dims) * (1 + 0.3 * np.arange(dims) / dims)).tolist()) for i in range(600)]
    rows += [(1000, rows[0][1])] * 200 + [(1001, None), (1002, [float("nan")] + [0.0] * (dims - 1)), (1003, [None] + [0.0] * (dims - 1)), (1004, [float("inf")] * dims), (1005, [])]
    got = run(spark, rows, tmp_path)
    ids, deviation, white, values, trace = brute([r for r in rows if r[1] != []])
    k = min(8, dims)
    assert len(got) == len(ids) * k and {r.n for r in got} == {len(ids)} and {r.vec_id for r in got} == set(ids)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    place = {i: j for j, i in enumerate(ids)}
    sign = {r.component: np.sign(r.whitened * white[0, r.component - 1]) for r in got if r.vec_id == ids[0]}
    for r in got:
        c = r.component - 1
        assert r.deviation == deviation[place[r.vec_id]] and abs(r.explained / (values[c] / trace) - 1) < 1e-9
        assert abs(r.whitened * sign[r.component] - white[place[r.vec_id], c]) < 1e-7


def test_low_rank_and_equal_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3, 50)).round(1)
    x = spark.createDataFrame([(np.floor(1024 * (rng.integers(-3, 4, 3) @ base)).astype(int).tolist(),) for _ in range(200)], "x array<long>")
    # flooring leaves a small full-rank part; exact multiples do not
    line = spark.createDataFrame([([int(k) * v for v in range(50)],) for k in rng.integers(-9, 9, 100)], "x array<long>")
    assert len(whitening.fit(x).values) == 8 and len(whitening.fit(line).values) == 1
    assert run(spark, [(i, [1.0] * 40) for i in range(9)], tmp_path) == []


def test_no_rows_and_other_lengths(spark, tmp_path):
    assert run(spark, [(1, None), (2, [])], tmp_path) == []
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(70)] + [(100, [1.0]), (None, [3.0, 2.0, 1.0])]
    out, model, _ = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)))
    ids = [r.vec_id for r in out.collect()]
    assert len(ids) == 71 and 100 not in ids and None in ids and model.n == 71 and len(model.values) == 2


def test_residuals_certify(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-1000, 1000, (3000, 48))
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    model = whitening.fit(table)
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    assert model.passes > whitening.LANCZOS and (model.residuals <= whitening.TOLERANCE * model.values[0]).all()
    assert np.allclose(v @ model.vectors, model.vectors * model.values, atol=1e-7 * model.values[0])
    assert np.allclose(model.values, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-12) and abs(model.trace / np.trace(v) - 1) < 1e-12


def test_values_beyond_64_bits(spark):
    x = np.array([[1 << 60]], np.int64)
    with pytest.raises(OverflowError):
        whitening.centred(x, 1000, np.zeros(1, np.int64))

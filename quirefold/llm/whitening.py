"""Whitening of vectors by their leading principal components, from Chebyshev-filtered subspace iteration.

The covariance V = XᵀX / n of the centred vectors is never formed. Every step is a pass over the written vectors: each task adds up
cᵀ(cQ) for its rows c, and one aggregation sums the cells, so the driver holds blocks of dimension x ``COMPONENTS + GUARD`` numbers
whatever the number of vectors.

A short Lanczos run bounds the spectrum from below. Rayleigh-Ritz on the block gives values and residuals; while a wanted
residual is above the tolerance, a Chebyshev polynomial of degree ``DEGREE`` in V (three-term recurrence, a pass for each degree) damps
everything between that bound and the smallest value of the block, QR makes the block orthonormal again, and the next
Rayleigh-Ritz step follows. Vectors that have converged stay and are projected out of the filter. The residuals certify the result: each value is within its residual of an eigenvalue, and the
residual is at most ``TOLERANCE`` of the value, or ``NOISE`` (rounding) of the greatest value.

Entries become integers first, so that sums, and differences from the mean, are exact before anything is multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.session import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS, GUARD, DEGREE, LANCZOS = 8, 24, 8, 8
LIFT, TOLERANCE, NOISE, RANK, ROUNDS = 1e10, 1e-12, 1.5e-14, 1e-12, 60


def integer_entries(vector: Column | str) -> Column:
    """floor(1024 c) + 100000 of every entry; null where the vector is null, empty or holds null or non-finite entries."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(v) > 0) & ~bad, F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(x: DataFrame, step, kind: str = "double") -> np.ndarray:
    """The sum of ``step``'s flat arrays over all rows; the driver gets as many numbers as the array has."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = step(_matrix(batch)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    got = x.select("x").mapInArrow(run, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(len(got), np.int64 if kind == "long" else np.float64)
    out[got["cell"].to_numpy()] = got["value"].to_numpy()
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if len(x) and int(np.abs(x).max()) * n + int(np.abs(sums).max()) >= 1 << 63:
        raise OverflowError("these entries and this number of vectors do not fit 64-bit integers")
    return x * n - sums


def _filtered(product, y: np.ndarray, vy: np.ndarray, value: float, fixed: np.ndarray, low: float, top: float) -> np.ndarray:
    """The block of Ritz vectors ``y`` behind the Chebyshev polynomial that is small between ``low`` and ``top``; ``value`` is their greatest.

    Converged vectors (``fixed``) are projected out of every step, and the degree is cut where the polynomial would lift the
    leading vector by more than ``LIFT`` above the rest: beyond that, rounding would bring the others into line with it.
    """
    bottom = min(low, top * (1 - 1e-3))
    half, middle = (top - bottom) / 2, (top + bottom) / 2
    ahead = max((value - middle) / half, 1 + 1e-9)
    degree = int(np.clip(np.arccosh(LIFT) / np.arccosh(ahead), 2, DEGREE))
    start = scale = 1 / ahead
    before, now = y, (vy - middle * y) * (start / half)
    for _ in range(degree - 1):
        now -= fixed @ (fixed.T @ now)
        after = 1 / (2 / start - scale)
        before, now = now, 2 * (product(now) - middle * now) * (after / half) - scale * after * before
        scale = after
    return now - fixed @ (fixed.T @ now)


@dataclass
class Whitening:
    """n vectors with these sums; values (descending) and unit vectors (columns) of their covariance, its trace, residuals and passes."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) / self.n @ self.vectors / np.sqrt(self.values)


def _lower_bound(product, rng: np.random.Generator, d: int) -> float:
    """Below the smallest eigenvalue, but for rounding: the least Ritz value of a short Lanczos run less its residual."""
    q = rng.standard_normal(d)
    basis, diagonal, beside = [q / np.linalg.norm(q)], [], []
    for _ in range(min(LANCZOS, d)):
        z = product(basis[-1][:, None])[:, 0]
        diagonal.append(z @ basis[-1])
        for _ in range(2):
            z = z - np.stack(basis, 1) @ (np.stack(basis, 1).T @ z)
        beside.append(float(np.linalg.norm(z)))
        if beside[-1] <= 1e-10 * max(diagonal):
            break
        basis.append(z / beside[-1])
    k = len(diagonal)
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: k - 1], 1) + np.diag(beside[: k - 1], -1))
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def fit(x: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE, seed: int = 1) -> Whitening | None:
    """The whitening of the rows of ``x`` (a column x of integer vectors of one length, best a written table).

    There are fewer components than asked for where the covariance has a smaller rank (values up to ``RANK`` of its trace count as
    zero), none where all vectors are equal, and no whitening without a row.
    """
    first = _summed(x, lambda m: np.concatenate((m.sum(0), [len(m)])), "long")
    if not len(first):
        return None
    sums, n, d = first[:-1], int(first[-1]), len(first) - 1
    passes, trace = 0, 0.0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes, trace

        def step(m: np.ndarray) -> np.ndarray:
            c = centred(m, n, sums) / n
            return np.append(c.T @ (c @ q), (c * c).sum())

        out = _summed(x, step) / n
        passes, trace = passes + 1, float(out[-1])
        return out[:-1].reshape(d, -1)

    rng = np.random.default_rng(seed)
    width = min(d, components + GUARD)
    low = _lower_bound(product, rng, d) if width < d else 0.0
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    for _ in range(ROUNDS):
        vq = product(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        y, vy = q @ turn, vq @ turn
        residuals = np.linalg.norm(vy - y * values, axis=0)
        fixed = residuals <= np.maximum(tolerance * values, NOISE * values[0])
        if width == d or trace == 0 or fixed[:components].all():
            break
        q = np.linalg.qr(np.concatenate((y[:, fixed], _filtered(product, y[:, ~fixed], vy[:, ~fixed], values[~fixed][0], y[:, fixed], low, max(values[-1], NOISE * values[0]))), 1))[0]
    else:
        raise ArithmeticError(f"residuals {residuals[:components] / values[0]} after {ROUNDS} rounds")
    kept = int((values[:components] > RANK * max(trace, 0.0)).sum())
    return Whitening(n, sums, values[:kept], y[:, :kept], trace, residuals[:kept], passes)


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance, less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = _summed(x, lambda m: model.project(m).sum(0)) / model.n

    def step(m: np.ndarray) -> np.ndarray:
        w = model.project(m) - mean
        return w.T @ w

    return float(np.abs(_summed(x, step).reshape(k, k) / model.n - np.eye(k)).max())


def _apply(model: Whitening):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            gap = centred(x, model.n, model.sums)
            if (gap.astype(float) ** 2).sum(1).max() < 2.0**62:
                deviation = [Decimal(int(v)) for v in (gap * gap).sum(1)]
            else:
                deviation = [Decimal(sum(int(v) ** 2 for v in row)) for row in gap]
            white = model.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
            at = batch.schema.get_field_index("x")
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(deviation, pa.decimal128(38, 0)), lists], names=[*names, "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(id, deviation, whitened array) of every usable row, the fitted whitening and its identity error.

    Null and empty vectors and vectors with null or non-finite entries are left out, as are vectors whose length is not the most frequent
    one (of equally frequent lengths the greatest counts). Repeated rows and rows with a null id come back like any other. deviation is the
    exact sum of (n x - S)². Other columns are not read. Without a usable row the result is empty and there is no whitening.
    """
    x = rows.select(F.col(id_col), integer_entries(vec_col).alias("x")).where("x is not null")
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    x = written(x.where(F.size("x") == (length[0].d if length else 0)))
    model = fit(x, components)
    kind = rows.schema[id_col].dataType.simpleString()
    names = f"`{id_col}` {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], names), None, 0.0
    return x.mapInArrow(_apply(model), names), model, identity_error(x, model)

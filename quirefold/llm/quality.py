"""Quality of whole texts: a convolutional network over bytes, in numpy.

Each byte has a learned vector. ``FILTERS`` learned filters of ``REACH`` times ``STRIDE`` = 12 bytes slide by 4 over the
whole text. Chunks of 512 bytes start every 256; a chunk keeps the largest response of each filter, a sigmoid turns those into its
probability, and the text's score is the mean over all its chunks. Nothing is cut off: a text of any length is all chunks.

The fit runs on at most ``PER_CLASS`` labelled texts of either class, the only bounded step, and on all their chunks; a text's chunks
weigh as much together as any other text's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import arrays as A
from quirefold.llm.toxicity import apply_score, learned, sigmoid, training_rows

PER_CLASS = 1000
FILTERS = 16
EMBED = 8
HALF = 256
STRIDE = 4
REACH = 3
PAD = 256


def laid_out(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids with every text padded to whole halves, and the number of halves of each text."""
    size = np.diff(starts)
    halves = np.where(size > 0, -(-(size + (REACH - 1) * STRIDE) // HALF), 0)
    to = (np.cumsum(halves) - halves) * HALF
    ids = np.full(int(halves.sum()) * HALF, PAD, np.int16)
    ids[A.ragged(to, size)] = data
    return ids, halves


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"e": rng.standard_normal((PAD + 1, EMBED)) * 0.5, "f": rng.standard_normal((REACH * STRIDE * EMBED, FILTERS)) * 0.2, "c": np.zeros(FILTERS), "o": rng.standard_normal(FILTERS) * 0.3, "b": np.zeros(1)}
    w["e"][PAD] = 0
    return {k: v.astype(np.float32) for k, v in w.items()}


def half_peaks(w, ids: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each half chunk."""
    rows = w["e"][ids].reshape(-1, STRIDE * EMBED)
    parts = w["f"].reshape(REACH, STRIDE * EMBED, FILTERS)
    near = rows @ parts[0]
    for k in range(1, REACH):
        near[:-k] += (rows @ parts[k])[k:]
    near[ids[::STRIDE] == PAD] = 0  # behind a text's end; what follows belongs to another
    return near.reshape(-1, HALF // STRIDE, FILTERS).max(axis=1)


def combined(w, peaks: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """One probability per text: the mean over its overlapping chunks; a text without bytes gets that of no response."""
    chunks = np.maximum(halves - 1, np.minimum(halves, 1))
    text = np.repeat(np.arange(len(halves)), chunks)
    first = A.ragged(np.cumsum(halves) - halves, chunks)
    second = np.where(halves[text] > 1, first + 1, first)
    p = sigmoid(np.maximum(np.maximum(peaks[first], peaks[second]) + w["c"], 0) @ w["o"] + w["b"][0])
    none = float(sigmoid(w["b"][0]))
    return np.where(chunks > 0, np.bincount(text, p, len(halves)) / np.maximum(chunks, 1), none)


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 8, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights from whole texts and 0/1 labels; without both classes every score is the share of label 1."""
    w, rng = start_weights(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    rows, ys, shares = [], [], []
    data, starts = A.text_bytes(texts)
    for i, j in A.chunks(starts):
        ids, halves = laid_out(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        at = np.cumsum(halves) - halves
        for t in range(j - i):
            count = max(halves[t] - 1, min(halves[t], 1))
            for k in range(count):
                a = (at[t] + k) * HALF
                b = a + (2 * HALF if halves[t] > 1 else HALF)
                rows.append(np.append(ids[a:b], np.full(2 * HALF - (b - a), PAD, np.int16)))
                ys.append(labels[i + t])
                shares.append(1 / count)
    y = np.array(ys, np.float32)
    if len(set(ys)) < 2:
        share = (labels.sum() + 0.01) / (len(labels) + 0.02)
        w["o"][:], w["b"][0] = 0, np.log(share / (1 - share))
        return w
    ids, share = np.array(rows), np.array(shares)
    total = np.array([share[y == c].sum() for c in (0, 1)])
    weight = (share * len(y) / (2 * total[y.astype(int)])).astype(np.float32)  # classes and texts count alike
    moment, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}, 0
    for _ in range(max(epochs, -(-400 * 64 // len(y)))):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            some = order[i : i + 64]
            g = gradients(w, ids[some], y[some], weight[some])
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                w[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            w["e"][PAD] = 0
    return w


def chunk_probability(w, ids):
    x = w["e"][ids].reshape(len(ids), -1, STRIDE * EMBED)
    n = x.shape[1] - REACH + 1
    x = np.concatenate([x[:, k : k + n] for k in range(REACH)], axis=2)
    y = x @ w["f"]
    top = y.argmax(axis=1)
    peak = np.take_along_axis(y, top[:, None], axis=1)[:, 0] + w["c"]
    return sigmoid(np.maximum(peak, 0) @ w["o"] + w["b"][0]), x, top, peak


def gradients(w, ids, y, weight) -> dict[str, np.ndarray]:
    p, x, top, peak = chunk_probability(w, ids)
    d = ((p - y) * weight / len(y)).astype(w["e"].dtype)
    d_peak = d[:, None] * w["o"] * (peak > 0)
    seen = np.take_along_axis(x, top[:, :, None], axis=1)  # the bytes under each filter's largest response
    d_seen = d_peak[:, :, None] * w["f"].T
    g_e = np.zeros_like(w["e"])
    place = top[:, :, None] * STRIDE + np.arange(REACH * STRIDE)
    which = np.take_along_axis(ids[:, None, :], place.reshape(len(ids), 1, -1), axis=2).ravel()
    np.add.at(g_e, which, d_seen.reshape(-1, EMBED))
    g_e[PAD] = 0
    return {"o": np.maximum(peak, 0).T @ d, "b": d.sum(keepdims=True), "c": d_peak.sum(axis=0), "f": np.einsum("bfk,bf->kf", seen, d_peak), "e": g_e}


def scorer(w):
    def score(column: pa.Array) -> np.ndarray:
        data, starts = A.text_bytes(column)
        out = np.zeros(len(column))
        for i, j in A.chunks(starts):
            ids, halves = laid_out(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            total, step = int(halves.sum()), 1024
            peaks = []
            for k in range(0, total, step):  # each step also reads the half behind it, for the filters that reach over
                to = min(k + step + 1, total) * HALF
                peaks.append(half_peaks(w, ids[k * HALF : to])[:step])
            out[i:j] = combined(w, np.concatenate(peaks) if peaks else np.zeros((0, FILTERS)), halves)
        return out

    return score


def score_texts(docs: DataFrame, labels: DataFrame, learn=None, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) after its columns; a column of that name is replaced.

    ``learn`` says which rows of ``labels`` (doc_id, quality) may teach. Only texts enter a score. Null and empty texts get the probability of no response;
    labels other than 0 and 1 are left out; an empty table stays empty.
    """
    rows = training_rows(docs, labels, "quality", F.lit(True) if learn is None else learn, per_class)
    return apply_score(docs, scorer(learned(rows, fit)))

"""Toxicity of whole texts: a bidirectional gated recurrent network over word and character inputs, in numpy.

A text is read as words (runs of non-space bytes, A-Z folded, ASCII punctuation at the ends dropped; runs of more than ``PIECE`` bytes fall into overlapping
pieces of that length). The word input is an embedding of the hashed word, the character input the maximum, by dimension, of learned vectors of all its hashed
runs of ``GRAMS`` bytes. Windows of ``WINDOW`` words start every ``WINDOW // 2`` words and cover the
whole text; each is read in both directions, attention pools the states, and a sigmoid gives the window's probability. The
text's score is that of its most toxic window. Training learns from labels of whole texts: each epoch picks the highest windows of every
training text under the current weights and fits those.

The fit runs on at most ``PER_CLASS`` labelled texts of either class, the smallest by a hash of the id; that is the only
bounded step. Everything else is one Arrow pass over all texts with 5 MB of weights.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quirefold.llm import arrays as A

WINDOW = 40
PER_CLASS = 2500
BUCKETS = 1 << 17
GRAM_BUCKETS = 1 << 19
GRAMS = (3, 4, 5)
PIECE = 24
EMBED = 4
HIDDEN = 6
TRIM = np.zeros(256, bool)
TRIM[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def inputs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word its bucket and the number of its spelling, the first word of each text; the gram buckets of all spellings, and where each starts."""
    begin, end, at = A.words(data, starts)
    prefix = A.prefix_hash(data, A.LETTER_FOLDED)
    for _ in range(2):
        if len(begin):
            end = end - ((end - begin > 1) & TRIM[data[end - 1]])
            begin = begin + ((end - begin > 1) & TRIM[data[begin]])
    step = PIECE // 2
    count = np.maximum(-(-(end - begin - PIECE) // step), 0) + 1
    begin, end, at = np.repeat(begin, count) + A.ragged(np.zeros(len(count), np.int64), count) * step, np.repeat(end, count), np.concatenate(([0], np.cumsum(count)))[at]
    end = np.minimum(begin + PIECE, end)
    spelled = A.spans_hash(prefix, begin, end)
    _, one, head = np.unique(spelled, return_index=True, return_inverse=True)
    grams, gram_at = _grams(prefix, begin[one], end[one])
    return (spelled & np.uint64(BUCKETS - 1)).astype(np.int32), head.astype(np.int32), at, grams, gram_at


def _grams(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all grams of each span, a shorter span being its own gram, and where those of each span start."""
    counts = [np.maximum(end - begin - g + 1, int(g == GRAMS[0])) for g in GRAMS]
    place = np.concatenate(([0], np.cumsum(sum(counts))))
    out, first = np.zeros(place[-1], np.int32), place[:-1]
    for g, count in zip(GRAMS, counts, strict=True):
        start = A.ragged(begin, count)
        out[A.ragged(first, count)] = A.spans_hash(prefix, start, np.minimum(start + g, np.repeat(end, count))) & np.uint64(GRAM_BUCKETS - 1)
        first = first + count
    return out, place


def pooled(table: np.ndarray, grams: np.ndarray, gram_at: np.ndarray, some: np.ndarray | None = None, winners: bool = False):
    """The character input of ``some`` spellings (all by default); with ``winners`` also the bucket each number comes from."""
    some = np.arange(len(gram_at) - 1) if some is None else some
    count = gram_at[some + 1] - gram_at[some]
    bucket = grams[A.ragged(gram_at[some], count)]
    if not len(bucket):
        return np.zeros((0, EMBED), np.float32)
    each = table[bucket]
    best = np.maximum.reduceat(each, np.cumsum(count) - count, axis=0)
    if not winners:
        return best
    owner = np.repeat(np.arange(len(some)), count)
    won = np.zeros(best.shape, np.int64)
    row, dim = np.nonzero(each == best[owner])
    won[owner[row], dim] = bucket[row]
    return best, won


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of all overlapping windows; a text without words has none."""
    size, step = np.diff(at), WINDOW // 2
    count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // step), 0) + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    first = A.ragged(np.zeros(len(count), np.int64), count) * step + at[:-1][text]
    return first, np.minimum(WINDOW, at[1:][text] - first), text


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
    w = {"word": draw(BUCKETS, EMBED, scale=0.05), "head": draw(GRAM_BUCKETS, EMBED, scale=0.05)}
    for d in "fb":
        w |= {f"x{d}": draw(2 * EMBED, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return w | {"a": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "o": draw(2 * HIDDEN), "bias": np.full(1, -1.0, np.float32)}


def forward(w, word, head, first, length, keep=False):
    """Window probabilities; with ``keep`` also what the backward pass needs. ``w["head"]`` holds the character input of each number in ``head``."""
    steps = int(length.max())
    cols = np.arange(steps)
    live = cols < length[:, None]
    index = np.where(live, first[:, None] + cols, first[:, None])
    ids, heads = word[index], head[index]
    x = np.concatenate((w["word"][ids], w["head"][heads]), axis=2)
    mask = live.astype(np.float32)
    states, tape = [], {}
    h3 = HIDDEN
    for d in "fb":
        pre = x @ w[f"x{d}"] + w[f"c{d}"]
        h = np.zeros((len(first), h3), np.float32)
        out = np.zeros((len(first), steps, h3), np.float32)
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            rec = h @ w[f"u{d}"]
            gates = sigmoid(pre[:, t, : 2 * h3] + rec[:, : 2 * h3])
            r, z = gates[:, :h3], gates[:, h3:]
            n = np.tanh(pre[:, t, 2 * h3 :] + r * rec[:, 2 * h3 :])
            m = mask[:, t : t + 1]
            new = m * (z * h + (1 - z) * n) + (1 - m) * h
            if keep:
                saved.append((t, h, r, z, n, rec[:, 2 * h3 :], m))
            out[:, t] = h = new
        states.append(out)
        tape[d] = saved
    s = np.concatenate(states, axis=2)
    k = np.tanh(s @ w["a"])
    e = np.where(live, k @ w["v"], -1e9)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    alpha = e / e.sum(axis=1, keepdims=True)
    pooled = (alpha[:, :, None] * s).sum(axis=1)
    p = sigmoid(pooled @ w["o"] + w["bias"][0])
    return (p, (ids, heads, x, s, k, alpha, pooled, tape, mask)) if keep else p


def gradients(w, kept, p, y, weight):
    ids, heads, x, s, k, alpha, pooled, tape, mask = kept
    g = {}
    d_logit = ((p - y) * weight / len(p)).astype(np.float32)
    g["o"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pool = d_logit[:, None] * w["o"]
    d_s = alpha[:, :, None] * d_pool[:, None, :]
    d_alpha = (s * d_pool[:, None, :]).sum(axis=2)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
    g["v"] = (k * d_e[:, :, None]).sum(axis=(0, 1))
    d_k = d_e[:, :, None] * w["v"] * (1 - k * k)
    g["a"] = np.einsum("bti,btj->ij", s, d_k)
    d_s = d_s + d_k @ w["a"].T
    d_x = np.zeros_like(x)
    hn = HIDDEN
    for i, d in enumerate("fb"):
        d_h = np.zeros((len(p), hn), np.float32)
        gx, gu, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"c{d}"])
        for t, h, r, z, n, rec_n, m in reversed(tape[d]):
            d_h = d_h + d_s[:, t, i * hn : (i + 1) * hn]
            dn = m * d_h * (1 - z) * (1 - n * n)
            dz = m * d_h * (h - n) * z * (1 - z)
            dr = dn * rec_n * r * (1 - r)
            pre, rec = np.concatenate((dr, dz, dn), axis=1), np.concatenate((dr, dz, dn * r), axis=1)
            gx += x[:, t].T @ pre
            gu += h.T @ rec
            gc += pre.sum(axis=0)
            d_x[:, t] += pre @ w[f"x{d}"].T
            d_h = d_h * (1 - m) + m * d_h * z + rec @ w[f"u{d}"].T
        g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
    d_x *= mask[:, :, None]
    return g, (ids.ravel(), heads.ravel(), d_x.reshape(-1, 2 * EMBED))


def log_odds(buckets, n_buckets: int, labels: np.ndarray) -> np.ndarray:
    """How much likelier a bucket is in toxic texts, counted once per text, pulled to 0 where rare; ``buckets`` yields those of each text."""
    counts = np.zeros((2, n_buckets))
    for y, mine in zip(labels, buckets, strict=True):
        counts[y, np.unique(mine)] += 1
    share = [(c + 0.5) / (1 + (labels == y).sum()) for y, c in enumerate(counts)]
    return np.log(share[1] / share[0]) * (1 - np.exp(-counts[1] / 4 - counts[0] / 8))


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 8, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from whole texts and their 0/1 labels; without both classes all scores are the share of label 1."""
    w = start_weights(seed)
    labels = np.asarray(labels, np.int64)
    data, starts = A.text_bytes(texts)
    parts = [inputs(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]) for i, j in A.chunks(starts)]
    word = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
    base = np.cumsum([0, *(len(p[4]) - 1 for p in parts)])
    head = np.concatenate([np.zeros(0, np.int64), *(p[1] + k for p, k in zip(parts, base[:-1], strict=True))])
    grams = np.concatenate([np.zeros(0, np.int32), *(p[3] for p in parts)])
    gram_at = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(p[4]) for p in parts)]))))
    at = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(p[2]) for p in parts)]))))
    first, length, text = windows(at)
    if len(set(labels[text])) < 2:
        w["o"][:] = 0
        share = (labels.sum() + 0.01) / (len(labels) + 1)
        w["bias"][0] = np.log(share / (1 - share))
        return w
    texts_of = [(int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]
    spellings = (np.unique(head[a:b]) for a, b in texts_of)
    # words of one training text alone would be learned by heart in place of their characters: like unseen ones they have no word input
    seen = np.zeros(len(w["word"]), np.int64)
    for a, b in texts_of:
        seen[np.unique(word[a:b])] += 1
    known = seen > 1
    w["word"][:, 0] = log_odds((word[a:b] for a, b in texts_of), len(w["word"]), labels) / 3
    w["word"][~known] = 0
    w["head"][:, 0] = log_odds((grams[A.ragged(gram_at[u], gram_at[u + 1] - gram_at[u])] for u in spellings), len(w["head"]), labels) / 3
    for d in "fb":  # the evidence of a word enters the candidate state from the start
        w[f"x{d}"][[0, EMBED], 2 * HIDDEN] = 1.0
    w["v"][0] = w["o"][0] = w["o"][HIDDEN] = 1.0
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items() if k not in ("word", "head")}
    step, positives = 0, max(1, labels.sum())
    for epoch in range(epochs):
        now = w | {"head": pooled(w["head"], grams, gram_at)}
        score = np.concatenate([forward(now, word, head, first[i : i + 512], length[i : i + 512]) for i in range(0, len(first), 512)])
        ranked = np.lexsort((-score, text))
        place = np.arange(len(ranked)) - np.searchsorted(text[ranked], text[ranked])
        chosen = ranked[place < np.where(labels[text[ranked]] == 1, 1, 2)]
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(max(1, -(-3000 // len(chosen))))])  # few texts pass several times an epoch
        for i in range(0, len(chosen), 128):
            some = chosen[i : i + 128]
            y = labels[text[some]].astype(np.float32)
            weight = np.where(y == 1, (len(labels) - positives) / positives, 1.0).clip(0.2, 10).astype(np.float32)
            used = np.unique(head[A.ragged(first[some], length[some])])
            now["head"][used], won = pooled(w["head"], grams, gram_at, used, True)
            p, kept = forward(w | {"head": now["head"]}, word, head, first[some], length[some], True)
            g, (ids, heads, d_x) = gradients(w, kept, p, y, weight)
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                w[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            again = known[ids]
            np.add.at(w["word"], ids[again], -0.5 * d_x[again, :EMBED])
            np.add.at(w["head"], (won[np.searchsorted(used, heads)], np.arange(EMBED)), -0.5 * d_x[:, EMBED:])
    return w


def scorer(w):
    """An Arrow pass: the highest window probability of each text; texts without words get that of no evidence, a low score."""
    small = {k: (v.astype(np.float32)) for k, v in w.items()}
    for k in ("word", "head"):
        small[k] = small[k].astype(np.float16)

    def score(column: pa.Array) -> np.ndarray:
        full = {k: v.astype(np.float32) for k, v in small.items()}
        data, starts = A.text_bytes(column)
        out = np.zeros(len(column))
        none = float(min(0.49, sigmoid(full["bias"][0])))
        for i, j in A.chunks(starts):
            word, head, at, grams, gram_at = inputs(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            now = full | {"head": pooled(full["head"], grams, gram_at)}
            first, length, text = windows(at)
            best = np.full(j - i, -1.0)
            for k in range(0, len(first), 2048):
                np.maximum.at(best, text[k : k + 2048], forward(now, word, head, first[k : k + 2048], length[k : k + 2048]))
            out[i:j] = np.where(best < 0, none, best)
        return out

    return score


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled texts of either class, the smallest by a hash of the id; all copies of a row's label count once."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y")).where(learn).dropDuplicates(["doc_id"])
    picks = [known.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picks[0].union(picks[1])), "doc_id")
    return rows.orderBy("doc_id", F.xxhash64("text")).limit(4 * per_class).select("text", "y")


def learned(rows: DataFrame, fit) -> dict[str, np.ndarray]:
    """The weights that ``fit`` finds for the bounded training rows; it runs in one task, and the driver gets the weights alone."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t, packed = pa.Table.from_batches(got).combine_chunks(), io.BytesIO()
            np.savez(packed, **fit(t["text"].combine_chunks(), t["y"].to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([packed.getvalue()], pa.binary())], names=["weights"])

    found = rows.coalesce(1).mapInArrow(A.tidy(run), "weights binary").collect()
    return dict(np.load(io.BytesIO(found[0].weights))) if found else fit(pa.array([], pa.string()), np.zeros(0, np.int64))


def score_texts(docs: DataFrame, labels: DataFrame, learn=None, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) after its columns; a column of that name is replaced.

    ``learn`` says which rows of ``labels`` (doc_id, toxic) may teach. Only texts enter a score. Null, empty and blank texts get the score of no
    evidence, below 0.5; labels other than 0 and 1 are left out; an empty table stays empty.
    """
    rows = training_rows(docs, labels, "toxic", F.lit(True) if learn is None else learn, per_class)
    return apply_score(docs, scorer(learned(rows, fit)))


def apply_score(docs: DataFrame, score) -> DataFrame:
    docs = docs.drop("score")
    names = docs.columns

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch.column("text")))], names=[*names, "score"])

    return docs.mapInArrow(A.tidy(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def reject(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, **kwargs) -> DataFrame:
    """The rows of ``docs`` that score below ``at_least``."""
    return score_texts(docs, labels, **kwargs).where(F.col("score") < at_least).drop("score")

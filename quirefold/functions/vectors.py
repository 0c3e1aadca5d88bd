"""Vector columns: hash embedding, unit length, similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold import fixed_values as fv
from quirefold.functions.text import let, unnest
from quirefold.session import tidy

VECTOR = T.ArrayType(T.DoubleType())
MEMO_ENTRIES = 100_000  # some 20 MB a memo
PIECE = 256  # texts whose vectors are held at once


def _memo(digest) -> Callable[[str], int]:
    """Hash a token to a dimension, remembering the most recent tokens per task."""
    seen: dict[str, int] = {}

    def dim(token: str) -> int:
        d = seen.get(token)
        if d is None:
            if len(seen) >= MEMO_ENTRIES:
                seen.clear()
            d = seen[token] = int(digest(token.encode("utf-8")).hexdigest(), 16) % fv.EMBED_DIM
        return d

    return dim


def hash_vector(text: str, word_dim: Callable[[str], int], tri_dim: Callable[[str], int]) -> np.ndarray:
    """Words weigh 1 + 1/position, each character trigram 0.3; unit length, zeros for no words."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(fv.EMBED_DIM)
    at = [word_dim(w) for w in tokens]
    vec = np.bincount(at, weights=1.0 + 1.0 / np.arange(1, len(at) + 1), minlength=fv.EMBED_DIM)
    tri = [tri_dim(w[j : j + 3]) for w in tokens for j in range(len(w) - 2)]
    if tri:
        vec = vec + 0.3 * np.bincount(tri, minlength=fv.EMBED_DIM)
    return vec / np.linalg.norm(vec)


def _embed_pieces(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    word_dim, tri_dim = _memo(hashlib.md5), _memo(hashlib.sha256)
    for batch in texts:
        for lo in range(0, max(1, len(batch)), PIECE):
            part = batch.slice(lo, PIECE)
            out = np.zeros((len(part), fv.EMBED_DIM))
            for i, text in enumerate(part):
                out[i] = hash_vector(text.as_py() or "", word_dim, tri_dim)
            at = np.arange(len(part) + 1, dtype=np.int32) * fv.EMBED_DIM
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(out.ravel()))


@F.arrow_udf(VECTOR)
def hash_embed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow batches in, 384-dimensional unit vectors out, in pieces whose size does not depend on the batch.

    Character trigrams blow up as rows (one per character of the corpus), so they are
    counted inside the batch and only the vector leaves the task.
    """
    yield from tidy(_embed_pieces)(texts)


def embed_external(df: DataFrame, text: str, batch_fn: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """Vectors from a caller's batch function (a hosted or local model), brought to unit length."""

    @F.pandas_udf(VECTOR)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.asarray(v, dtype="float64") for v in batch_fn(batch.tolist())], index=batch.index)

    return df.withColumn(out, l2_normalize(run(F.col(text))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(v: Column) -> Column:
    """``v`` at unit length; a zero vector stays as it is."""

    def scaled(a: Column) -> Column:
        norm = F.sqrt(dot(a, a))
        return let(norm, lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n)))

    return let(v, scaled)


def cosine01(a: Column, b: Column) -> Column:
    """Similarity of unit vectors on the scale 0 to 1, four decimals."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) + 1) / 2)), 4)


def sparse(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, weight) rows of the non-zero entries."""
    entries = F.transform(vector, lambda x, i: F.struct(i.alias("dim"), x.alias("weight")))
    return df.select(key, unnest(F.filter(entries, lambda e: e["weight"] != 0), "dim", "weight"))

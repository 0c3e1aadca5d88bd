"""Array helpers for Arrow tasks: text buffers, words, polynomial hashes and fixed-size filters.

Texts of a batch lie end to end in one byte array, so that splitting and hashing cost a few array
passes whatever the number of texts. Work goes in chunks of whole texts of about ``CHUNK`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import tidy  # noqa: F401

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    shifted = np.empty_like(x)
    x ^= np.right_shift(x, np.uint64(30), out=shifted)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=shifted)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


LETTER = mix(np.arange(1, 257, dtype=np.uint64))
LETTER_FOLDED = LETTER[FOLD]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray, letters: np.ndarray = LETTER) -> np.ndarray:
    """h with h[j] - h[i], brought back by the power of i, as the hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    body = out[1:]
    np.take(letters, data, out=body, mode="clip")
    body *= powers(len(data))[0]
    np.cumsum(body, out=body)
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = prefix[end]
    out -= prefix[start]
    out *= powers(len(prefix))[1][start]
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each starts (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(starts: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text stands alone."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(int(np.searchsorted(starts, starts[first] + limit, "right")) - 1, first + 1)
        yield first, last
        first = last


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes, and the index of the first word of each text."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z folded to a-z."""
    return spans_hash(prefix_hash(data, LETTER_FOLDED), begin, end)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), then the same for each next entry."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(first - at, count)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python tasks in short Arrow batches: the session's usual 10,000 rows of long texts cost a task some hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class IdFilter:
    """A bit map of fixed size that says of an id 'perhaps' or 'no'; it is followed by an exact join.

    It keeps rows that cannot match out of a shuffle. Its size (1 MB) does not grow with the data: a full
    map lets all rows through, and the join still decides.
    """

    BITS = 23

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, ids: DataFrame, column: str) -> IdFilter:
        slot = F.expr(f"pmod(xxhash64({column}), {1 << cls.BITS})")
        marks = (
            ids.select(slot.alias("slot")).select(F.expr("slot div 64").alias("word"), F.expr("slot % 64").cast("int").alias("bit"))
            .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        )
        words = np.zeros((1 << cls.BITS) // 64, np.int64)
        got = marks.toArrow()
        words[got["word"].to_numpy()] = got["bits"].to_numpy()
        return cls(words.view(np.uint64))

    @staticmethod
    def slot_column(column: str):
        return F.expr(f"pmod(xxhash64({column}), {1 << IdFilter.BITS})")

    def maybe(self, slots: np.ndarray) -> np.ndarray:
        s = slots.astype(np.uint64)
        return (self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def range_of(column: str, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` lie below the value: a search over two levels of arrays, so that a row costs their square root."""
    if not cuts:
        return F.lit(0)
    step = max(2, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(column)))
    group = below(F.array(*[F.lit(int(g[-1])) for g in groups]))
    nested = F.array(*[F.array(*[F.lit(int(c)) for c in g]) for g in groups])
    return F.when(group >= len(groups), len(cuts)).otherwise(group * step + below(F.get(nested, group)))

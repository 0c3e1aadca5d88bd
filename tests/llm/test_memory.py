import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from quirefold.llm import arrays as A
from quirefold.llm import merge_dropout as M
from quirefold.llm import suffix_dedup as D
from quirefold.llm import templates as T


def texts(n):
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    return A.text_bytes(pa.array([" ".join(rng.choices(words, k=500)) for _ in range(n)]))


def peak(run) -> float:
    """MB of the second call: the first one fills tables that stay."""
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def chunk(data, starts, limit):
    i, j = next(A.chunks(starts, limit))
    return data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]


def test_segments_write_over_their_arrays():
    data, starts = chunk(*texts(400), A.CHUNK)
    assert len(data) > 1_000_000
    assert peak(lambda: D.segments(data, starts, 200)) < 48


def test_segments_as_by_brute_force():
    data, starts = A.text_bytes(pa.array(["", "ab" * 30, "abcabd" * 9 + "x", "short", "", "zyx" * 20, ""]))
    limit, anchor = 40, 32
    grams = A.spans_hash(A.prefix_hash(data), np.arange(len(data) - anchor + 1), np.arange(anchor, len(data) + 1))
    want = []
    for t, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        for p in range(a, b - limit + 1):  # the smallest gram by the upper half of its hash, the last on a tie
            best = min(range(p, p + limit - anchor + 1), key=lambda q: (int(grams[q]) >> 32, -q))
            if want and want[-1][0] == t and want[-1][3] == best - a:
                want[-1][2] = p - a
            else:
                want.append([t, p - a, p - a, best - a])
    text, _, _, lo, hi, apos = D.segments(data, starts, limit)
    assert np.stack((text, lo, hi, apos), 1).tolist() == want


def test_encoding_holds_little():
    table = M.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    data, starts = chunk(*texts(400), M.CHUNK)
    assert peak(lambda: M.encode(table, data, starts, 1, 0.1)) < 60


def test_windows_are_read_in_short_chunks():
    data, starts = texts(400)
    rows = [data[a:b].tobytes().decode() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    sizes = []

    def read(part, at):
        sizes.append(len(part))
        return [(k, 1, 0, "") for k in range(len(at) - 1)]

    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(rows)], names=["id", "text"])
    out = list(T._emit(read, T.FOUND)([batch]))
    assert sum(sizes) == len(data) and max(sizes) <= 1 << 18
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(400))

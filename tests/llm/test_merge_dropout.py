import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from quirefold.llm import arrays as A
from quirefold.llm import merge_dropout as M

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello wörld", "", " ", "  two  spaces \n\tand tabs ", "▁ literal ▁▁mark", "x", "日本語 テキスト 𝄞 ﬀ ё é", "a" * 300, "ab" * 200 + " tail", "🙂🙂 ok", "\x00\x01", "word " * 50,
    "supercalifragilistic antidisestablishmentarianism " * 3,
]


def ids(texts, seed=0, dropout=0.0):
    data, starts = A.text_bytes(pa.array(texts))
    flat, offsets = M.encode(M.pieces(MODEL), data, starts, seed, dropout)
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_without_dropout_as_the_library():
    rng = random.Random(4)
    texts = [t for t in TEXTS if "▁" not in t] + ["".join(rng.choice("abcdeé \nthing") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    assert ids(texts) == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_lossless_and_same_for_both_agendas(dropout):
    table = M.pieces(MODEL)
    data, starts = A.text_bytes(pa.array(TEXTS))
    flat, offsets = M.encode(table, data, starts, 5, dropout)
    back, ends = M.decode(table, flat, offsets)
    assert [bytes(back[a:b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == TEXTS
    rng = np.random.default_rng(1)
    chars = np.frombuffer("".join(rng.choice(list(" thingsare"), 2000)).encode("utf-32-le"), np.uint32).astype(np.int64)
    cuts = np.concatenate(([0], np.sort(rng.choice(np.arange(1, 2000), 90, False)), [2000]))
    keys = A.mix(np.arange(len(cuts) - 1, dtype=np.uint64))
    one, other = (M.segment(table, chars, cuts, keys, dropout, long) for long in (60, 0))
    assert all(np.array_equal(a, b) for a, b in zip(one, other, strict=True))


def test_seeds_vary_and_repeat():
    text = ["the quick brown foxes were jumping over everything " * 8]
    assert ids(text, 1, 0.2) == ids(text, 1, 0.2) != ids(text, 2, 0.2)
    assert len({str(ids(text, s, 0.2)) for s in range(10)}) == 10
    share = np.mean([len(ids(text, s, 0.3)[0]) for s in range(20)]) / len(ids(text)[0])
    assert share > 1.1


def test_on_tables(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "x"), (99, None), (100, "long one " * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as pieces", "'k' as kept")
    out = M.encode_texts(docs, MODEL, 0.1, 3).collect()
    assert len(out) == len(rows) and all(r.lossless and r.kept == "k" for r in out)
    assert {r.doc_id: r.decoded for r in out if r.doc_id in (3, 6, 99)} == {3: TEXTS[3], 6: TEXTS[6], 99: ""}
    assert M.encode_texts(docs.limit(0), MODEL).count() == 0


def test_every_occurrence_draws_for_itself(monkeypatch):
    one = " antidisestablishmentarianism"
    table, text = M.pieces(MODEL), one[1:] + one * 3000
    data, starts = A.text_bytes(pa.array([text]))
    flat, _ = M.encode(table, data, starts, 1, 0.2)
    cuts = np.cumsum(np.diff(table.bytes_at)[flat])
    begin = np.searchsorted(cuts, np.arange(len(text) // (len(one) - 1)) * len(one), "right")
    ways = {str(flat[a:b].tolist()) for a, b in zip(begin[:3000], begin[1:3001], strict=True)}
    assert len(ways) > 100
    # the shared results are those of encoding each occurrence by itself
    texts = [*TEXTS, "the quick brown foxes were jumping over everything " * 40]
    whole = ids(texts, 3, 0.1)
    monkeypatch.setattr(M, "BLOCK", 7)
    assert ids(texts, 3, 0.1) == whole
    monkeypatch.setattr(M, "LONG", 0)  # each occurrence is encoded by itself
    assert ids(texts, 3, 0.1) == whole


def test_occurrences_that_draw_alike_share_one_encoding(monkeypatch):
    text = " ".join(["antidisestablishmentarianism things are"] * 4000 + [f"once{k}" for k in range(500)])
    whole, units, segment = ids([text], 3, 0.1), [], M.segment

    def counted(table, chars, offsets, *more):
        units.append(len(offsets) - 1)
        return segment(table, chars, offsets, *more)

    monkeypatch.setattr(M, "segment", counted)
    assert ids([text], 3, 0.1) == whole
    assert sum(units) < 6200  # 7,000 of the 12,500 skip something, and a word that occurs once is encoded once
    monkeypatch.setattr(M, "OFTEN", 1 << 30)  # each occurrence by itself
    units.clear()
    assert ids([text], 3, 0.1) == whole and sum(units) == 12500

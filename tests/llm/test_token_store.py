import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quirefold.llm import arrays as A
from quirefold.llm import token_store as S

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "It's a test, isn't it?  Two  spaces \n\nline ", " lead", "trail ", "", " ", "a b", "x  y 　 z", "é è à  ñ ß x", "日本 語 text", "don't 'stop 'tis 're", "1 2 3 44 !! ?? ' s", "<|endoftext|> a <|endoftext|>b", "word " * 3000,
    "\t tab \r\n x", "a Ã b × c ÷", "\x1f \x1f x \x85 y",
]


def test_pieces_as_the_library():
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("ab 'sté \n1! Ã") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    data, starts = A.text_bytes(pa.array(texts))
    ids, at = S.encode(PATH, data, starts, 2)
    model = Tokenizer.from_file(PATH)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*model.encode(t, add_special_tokens=False).ids, 2], t


@pytest.mark.parametrize("rows", [4096, 5])
def test_round_trip(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(S, "SHARD_ROWS", rows)
    docs = [(k * 7 % 101, t) for k, t in enumerate(TEXTS * 6)] + [(500, None), (None, "x"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as shard", "2 as n").repartition(3)
    folder = f"file://{tmp_path}/store"
    shards = S.write_store(df, folder, PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in S.read_store(shards, folder).collect())
    model = Tokenizer.from_file(PATH)
    want = {(i, zlib.crc32(np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in docs if i is not None}
    assert len(got) == len(docs) - 1 and {(g[1], g[3]) for g in got} == want
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
    last = shards.orderBy("shard").collect()[-1].shard
    assert [x.tolist() for x in S.fetch(folder, last, 500)] == [[2]]
    (tmp_path / "store/dictionary.bin").write_bytes(b"other")
    with pytest.raises(ValueError, match="dictionary"):
        S.fetch(folder, last, 500)


def test_many_cuts(spark):
    cuts = [3 * k for k in range(200)]
    got = spark.range(700).withColumnRenamed("id", "doc_id").select("doc_id", A.range_of("doc_id", cuts).alias("s")).collect()
    assert all(r.s == sum(c < r.doc_id for c in cuts) for r in got)


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    shards = S.write_store(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert S.read_store(shards, folder).count() == 0


def test_new_pieces_go_through_the_library_together(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcé日'1!ÃX") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts = [" ".join(words), *TEXTS, " ".join(words[::-1]) + " 本", "<|im_start|> " + " ".join(words[:50])]
    model, given = Tokenizer.from_file(PATH), []
    real, special, _ = S.tokenizer(PATH)

    class Counted:
        def encode_batch_fast(self, rows, **how):
            given.extend(rows)
            return real.encode_batch_fast(rows, **how)

        def __getattr__(self, name):
            return getattr(real, name)

    S.tokenizer.cache_clear()
    fresh = S.tokenizer(PATH)
    monkeypatch.setattr(S, "tokenizer", lambda path: (Counted(), *fresh[1:]))
    data, starts = A.text_bytes(pa.array(texts))
    for _ in range(2):  # the second time every piece is known
        ids, at = S.encode(PATH, data, starts, 2)
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*model.encode(t, add_special_tokens=False).ids, 2], t
        assert len(given) < 2000

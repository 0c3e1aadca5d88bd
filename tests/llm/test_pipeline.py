import hashlib
import random
import re

import pytest

import corpus_pipeline as P
from quirefold import session
from quirefold.llm import suffix_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(60)
    rows, toxic = [], []
    for i in range(120):
        rows.append((i, text(rng.randint(60, 120)), "en", "s", 0))
        if i % 4 == 0:
            words = rows[-1][1].split()
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zzoof", "quirk"])
            rows[-1] = (i, " ".join(words), "en", "s", 0)
            toxic.append(i)
    near = rows[1][1].split()
    near[40] = "changed"
    rows += [(200, rows[1][1], "en", "s", 0), (201, " ".join(near), "en", "s", 0), (202, text(80) + " " + item + " " + text(20), "en", "s", 0)]
    rows += [(203 + k, text(50) + " " + passage + " " + text(50), "en", "s", 0) for k in range(2)]
    rows += [(300, None, None, None, None), (301, "", "en", None, 0)]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), {r[0]: r[1] for r in rows}, toxic, passage


def test_each_stage_decides(spark, folder):
    where, texts, toxic, passage = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = P.toxic_out(spark, docs, where)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(set(toxic) & ids) <= 2 and len(set(texts) - set(toxic) - ids) <= 2
    ids = {r.doc_id for r in P.near_copies_out(spark, docs, where).collect()}
    assert ids == set(texts) - {200, 201}
    cut = {r.doc_id: r for r in P.repeats_out(spark, docs, where).collect()}
    assert set(cut) == set(texts) and passage not in cut[203].text and cut[1].text == "" and cut[1].n_chars == 0 and cut[300].text is None
    assert cut[5].text == texts[5] and cut[203].n_chars == len(cut[203].text)
    assert {r.doc_id for r in P.leaks_out(spark, docs, where).collect()} == set(texts) - {202}


def test_whole_run(spark, folder):
    where, texts, *_ = folder
    out = P.run(spark, where)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.lossless for r in rows.values()) and 300 in rows and 202 not in rows and 201 not in rows
    assert rows[5].decoded_sha256 == hashlib.sha256(texts[5].encode()).hexdigest()


def test_split_characters_go_with_the_cut(spark):
    rows = [(1, "é" + "x" * 10 + "é"), (2, "ê" + "x" * 10 + "è")]
    out = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 11)
    assert {r.text for r in out.collect()} <= {"", "é", "ê", "è", "éé", "êè"}


def test_replacement_characters_of_the_text_stay(spark):
    rows = [(1, "a�b" + "x" * 11), (2, "c" + "x" * 11 + "�")]
    out = {r.doc_id: r.text for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 11).collect()}
    assert out == {1: "a�b", 2: "c�"}


def test_repeats_beside_any_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a" + "x" * 30), (2, "b" + "x" * 30), (2, None), (None, "")], "doc_id long, text string")
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("row", F.lit(1)).withColumn("spans", F.lit("s"))
    out = suffix_dedup.without_repeats(docs, 20).collect()
    assert sorted(((r.doc_id, r.text, r.m, r.row, r.spans) for r in out), key=str) == sorted([(1, "a", {"k": 1}, 1, "s"), (2, "b", {"k": 1}, 1, "s"), (2, None, {"k": 1}, 1, "s"), (None, "", {"k": 1}, 1, "s")], key=str)


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_release_gives_native_memory_of_the_driver_back(spark):
    if session.trim_native(spark) is None:
        pytest.skip("this Java has no System.trim_native_heap")
    held = [spark.sparkContext._jvm.java.util.zip.Deflater() for _ in range(800)]  # some 200 KB outside the heap each
    for d in held[:-1]:
        d.end()
    session.release(spark)
    before, after = map(int, re.search(r"(\d+)M->(\d+)M", session.trim_native(spark)).groups())
    assert before - after < 40

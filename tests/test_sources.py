import json

import pytest

from pyspark.sql import functions as F

from quirefold.session import shared_dir
from quirefold.sources import corpus, ingest, sinks


def test_golden_and_insert_absent(spark, tmp_path):
    row = {"id": "1", "question": "q1", "expected_answer": "a", "expected_document": "d", "expected_page": 2, "expected_drugs": [{"drug": "x", "dosage": "5 mg", "frequency": "daily"}], "category": "c", "difficulty": "easy"}
    (tmp_path / "g.json").write_text(json.dumps([row, row | {"id": "2"}, row | {"id": "3", "question": "q2"}]))
    g = corpus.load_golden(spark, str(tmp_path / "g.json"))
    assert g.first()["expected_drugs"][0]["dosage"] == "5 mg"
    known = g.filter("question = 'q2'")
    assert sorted(r["id"] for r in corpus.insert_absent(known, g, "question", "id").collect()) == ["1", "3"]


def test_notes_with_bad_bytes(spark, tmp_path):
    (tmp_path / "n1.txt").write_bytes(b"good \xff line\nsecond")
    row = corpus.load_notes(spark, str(tmp_path)).first()
    assert row["title"] == "n1.txt" and row["text"] == "good � line\nsecond"


def test_upsert_rewrites_touched_buckets_only(spark):
    path = shared_dir(spark)
    old = spark.createDataFrame([(i, f"old{i}") for i in range(40)], "doc_id long, content string")
    sinks.write_chunks(old, path, 8)
    before = {r["f"]: r["b"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f"), F.col("doc_bucket").alias("b")).distinct().collect()}
    new = spark.createDataFrame([(5, "new5a"), (5, "new5b")], "doc_id long, content string")
    for _ in range(2):
        sinks.upsert_chunks(spark, path, new, 8)
    now = spark.read.parquet(path)
    assert now.count() == 41 and {r["content"] for r in now.filter("doc_id = 5").collect()} == {"new5a", "new5b"}
    touched = now.filter("doc_id = 5").first()["doc_bucket"]
    after = {r["f"] for r in now.select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f for f, b in before.items() if b != touched} <= after


def test_persisted_runs_replace_themselves(spark):
    root = shared_dir(spark)
    df = spark.createDataFrame([(1, "x" * 80)], "conv_id long, q string").select("conv_id", sinks.conversation_title(F.col("q")).alias("title"))
    for run in ("a", "a", "b"):
        sinks.persist_answers({"conversations": df}, root, run)
    back = sinks.finished(spark, root, "conversations")
    assert back.count() == 2 and len(back.first()["title"]) == 60 and back.columns == ["conv_id", "title", "run_id"]
    assert sinks.sweep(spark, root, ["conversations"]) == 1 and sinks.sweep(spark, root, ["conversations"]) == 0
    assert sinks.finished(spark, root, "conversations").count() == 2


def test_a_run_that_dies_between_two_tables_is_not_seen(spark):
    root = shared_dir(spark)
    first, second = (spark.createDataFrame([(1, t)], "conv_id long, text string") for t in ("old", "new"))
    broken = second.select("conv_id", F.raise_error(F.lit("lost")).alias("text"))
    for tables in ({"a": second, "b": broken},):
        with pytest.raises(Exception, match="lost"):
            sinks.persist_answers(tables, root, "r")
    assert sinks.finished(spark, root, "a").count() == 0
    sinks.persist_answers({"a": first, "b": first}, root, "r")
    with pytest.raises(Exception, match="lost"):
        sinks.persist_answers({"a": second, "b": broken}, root, "r")
    assert [r.text for t in "ab" for r in sinks.finished(spark, root, t).collect()] == ["old", "old"]
    assert sinks.sweep(spark, root, ["a", "b"]) >= 2
    sinks.persist_answers({"a": second, "b": second}, root, "r")
    assert [r.text for t in "ab" for r in sinks.finished(spark, root, t).collect()] == ["new", "new"]


def test_a_long_conversation_is_one_document(spark):
    talk = [(1, t, "user" if t % 2 == 0 else "assistant", f"say {t}") for t in range(10_050)] + [(2, 7, "user", 'a "quoted"\nline')]
    m = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    c = spark.createDataFrame([(1, 1, 1, "- [1] Guide")], "conv_id long, turn long, citation_index int, line string")

    def documents(blocks):
        path = shared_dir(spark)
        sinks.write_documents(blocks, path)
        rows = spark.read.text(path, wholetext=True).select("conv_id", "value").collect()
        assert len(rows) == 2
        return {r["conv_id"]: r["value"] for r in rows}

    md = documents(sinks.export_markdown(m, "T", "care", c))
    assert md[1].startswith("# T\n**Conversation**: `1`\n\n---\n\n### Query:\nsay 0\n\n### Answer:\nsay 1\n\n#### Citations:\n- [1] Guide\n\n### Query:\nsay 2\n")
    assert md[1].endswith("### Answer:\nsay 10049\n\n---\n\n> care\n") and md[1].count("care") == 1
    js = {k: json.loads(v) for k, v in documents(sinks.export_json(m, c)).items()}
    assert js[1]["id"] == 1 and [x["content"] for x in js[1]["messages"]] == [t[3] for t in talk[:-1]]
    assert js[1]["messages"][1]["citations"] == [{"citation_index": 1, "line": "- [1] Guide"}]
    assert js[2]["messages"] == [{"turn": 7, "role": "user", "content": 'a "quoted"\nline'}]


def test_audit_and_bulk(spark):
    docs = spark.createDataFrame([(1, "One. Two.", "t1"), (2, " ", "t2"), (3, "Three.", "t1")], "doc_id long, text string, title string")
    fresh = corpus.unregistered(docs, spark.createDataFrame([("t2",)], "title string"))
    chunks, summary = ingest.bulk_ingest(fresh)
    assert summary.count() == 1
    audit = {r["doc_id"]: (r["status"], r["chunks_created"]) for r in ingest.ingest_audit(docs, ingest.bulk_ingest(docs)[0], {"bad": F.col("title") == "none"}).collect()}
    assert audit[2] == ("COMPLETED", 0) and audit[1] == ("COMPLETED", 1)
    assert ingest.document_chunks(chunks, 99).count() == 0

from pyspark.sql import functions as F

from quirefold.operators import deid

# semicolons keep the greedy address pattern from running on from an earlier number
NOTE = (
    "PATIENT NAME: Robert Miller, MRN: AB-123456; DOB: 04/12/1961; Phone +1 415-555-0134; mail r.miller@example.org; SSN 123-45-6789; "
    "Aadhaar 1234 5678 9012; Robert Miller was seen by Dr. Cardiology Team; Lives at 42 Oak Street, Springfield."
)


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "own%d" % i) for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_mask_and_restore(spark):
    out = deid.deidentify(docs(spark, NOTE, "Nothing private here.")).orderBy("doc_id").collect()
    masked = out[0]["masked_text"]
    for value in ("Robert Miller", "AB-123456", "04/12/1961", "r.miller@example.org", "123-45-6789", "1234 5678 9012"):
        assert value not in masked
    assert masked.count("[PATIENT_1]") == 2 and "[PATIENT_2]" not in masked
    assert "Cardiology Team" in masked  # a listed word is no name
    assert out[1]["masked_text"] == "Nothing private here." and out[1]["pii_entity_count"] == 0
    d = deid.deidentify(docs(spark, NOTE, "x"))
    back = deid.unmask(d.select("doc_id", "masked_text"), deid.mapping_table(d)).orderBy("doc_id").collect()
    assert back[0]["original_text"] == NOTE and back[1]["original_text"] == "x"


def test_overlaps_keep_earliest_then_longest_and_skipped_spans_do_not_block(spark):
    rows = [(1, 0, 10, "A", "x", 0), (1, 5, 20, "B", "y", 1), (1, 12, 15, "C", "z", 2), (1, 30, 33, "D", "s", 4), (1, 30, 38, "E", "l", 5), (1, 40, 42, "F", "f", 3), (1, 40, 42, "G", "g", 2)]
    spans = spark.createDataFrame(rows, "doc_id long, start int, end int, category string, original string, detector int")
    assert [r["category"] for r in deid.resolve_overlaps(spans).orderBy("start").collect()] == ["A", "C", "E", "G"]


def test_placeholders_number_per_category_and_first_category_wins(spark):
    rows = [(1, 0, 3, "PHONE", "111", 1), (1, 5, 8, "EMAIL", "a@b", 0), (1, 10, 13, "PHONE", "222", 1), (1, 15, 18, "SSN", "111", 2)]
    spans = spark.createDataFrame(rows, "doc_id long, start int, end int, category string, original string, detector int")
    got = {r["original"]: r["placeholder"] for r in deid.assign_placeholders(spans).collect()}
    assert got == {"111": "[PHONE_1]", "a@b": "[EMAIL_1]", "222": "[PHONE_2]"}
    long = deid.deidentify(docs(spark, "call 415-555-0134 or 415-555-0199 or 415-555-0134"))
    assert long.first()["masked_text"] == "call [PHONE_1] or [PHONE_2] or [PHONE_1]"


def test_leaks_are_found_and_stop_the_job(spark):
    d = deid.deidentify(docs(spark, NOTE))
    assert deid.leak_audit(d).count() == 0
    found = deid.leak_audit(d, "text").first()["reasons"]
    assert found == ["EMAIL", "PHONE", "SSN", "AADHAAR", "RAW_VALUE"]
    long = deid.leak_audit_long(d.select("doc_id", F.col("text").alias("masked_text")), deid.mapping_table(d))
    assert long.first()["reasons"] == found
    try:
        deid.assert_no_leak(long)
        raise SystemExit("not stopped")
    except ValueError:
        pass


def test_literal_placeholders_are_quarantined(spark):
    assert [r["quarantined"] for r in deid.deidentify(docs(spark, "see [PHONE_1]", "fine")).orderBy("doc_id").collect()] == [True, False]


def test_diff_is_for_owner_and_administrator_only(spark):
    d = deid.deidentify(docs(spark, NOTE, NOTE))
    people = spark.createDataFrame([("own0", False), ("other", False), ("boss", True)], "principal string, is_admin boolean")
    got = deid.note_diff(d.select("doc_id", "source", "masked_text"), deid.mapping_table(d), people).collect()
    assert sorted((r["principal"], r["doc_id"]) for r in got) == [("boss", 0), ("boss", 1), ("own0", 0)]
    assert all(r["original_text"] == NOTE for r in got)

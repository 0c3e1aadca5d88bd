from quirefold.functions.register import register_udfs


def test_sql_functions(spark):
    register_udfs(spark)
    row = spark.sql("SELECT estimate_tokens('one two  three') n, bm25_tokens('A-bc De') t, cosine01(array(1D, 0D), array(0D, 1D)) c, size(hash_embed('x')) d").first()
    assert (row["n"], row["t"], row["c"], row["d"]) == (3, ["bc", "de"], 0.5, 384)
    spans = spark.sql("SELECT s.* FROM VALUES ('mail a@b.org, Patient: Ann Lee') v(t), LATERAL pii_spans(t) s").collect()
    assert sorted((r["category"], r["original"]) for r in spans) == [("EMAIL", "a@b.org"), ("PATIENT", "Ann Lee")]

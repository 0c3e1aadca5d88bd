from quirefold.llm import licenses as L
from quirefold.llm.license_texts import LICENSES


def test_variants_match_and_parts_do_not(spark):
    mit = LICENSES["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("\n", "\n   ") + "\n© me"), (3, mit.replace("sublicense", "sub-licence").replace(",", ";")),
        (4, mit[:-20]), (5, "intro\n* released under the MIT Licence *\nmore\nReleased under the MIT License.\n"), (6, "Licensed under CC BY-NonCommercial 4.0"), (7, None), (8, ""), (9, " \n"),
        (10, "Copyright 2020 all of it"), (None, "Released under the MIT License."), (1, mit), (11, "x " * 100000 + "\nLicensed under the Apache Licence, version 2.0"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as whole", "2 as license_id", "3 as digest")
    got = {(r.doc_id, r.license_id): (r.whole, r.n_lines) for r in L.scan(docs, L.known(spark)).collect()}
    assert got == {
        (1, "MIT"): (True, 0), (2, "MIT"): (True, 0), (3, "MIT"): (True, 0), (5, "MIT notice"): (False, 2), (6, "CC-BY-NC-4.0 notice"): (True, 1), (None, "MIT notice"): (True, 1),
        (11, "Apache-2.0 notice"): (False, 1),
    }
    assert L.scan(docs.limit(0), L.known(spark)).count() == 0
    assert "Python" not in L.scan(docs, L.known(spark))._jdf.queryExecution().toString()


def test_canonical_form_is_computed_once(spark):
    """One pattern for the texts and one for their lines; conditions on computed columns used to repeat them."""
    docs = spark.createDataFrame([(1, "Released under the MIT License.\nmore")], "doc_id long, text string")
    known = spark.createDataFrame([("0", "MIT notice")], "digest string, license_id string")
    plan = L.scan(docs, known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("all rights reserved") == 2

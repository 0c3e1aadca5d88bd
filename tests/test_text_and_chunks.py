import random

from pyspark.sql import functions as F

from quirefold.functions import text as tx
from quirefold.operators import chunking, layout


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sentences(spark, text, keep_empty=False):
    return docs(spark, text).select(tx.split_sentences(F.col("text"), keep_empty).alias("s")).first()["s"]


def test_sentences_respect_abbreviations_and_decimals(spark):
    text = "Dr. Smith prescribed Apixaban 2.5 mg twice daily. Follow up in 3 months vs. 6 months. Monitor renal function."
    assert len(sentences(spark, text)) == 3


def test_sentence_edge_cases(spark):
    assert sentences(spark, "  \n ") == []
    assert sentences(spark, " ", keep_empty=True) == []
    assert sentences(spark, "One. \n\nTwo? Three") == ["One.", "Two?", "Three"]
    assert sentences(spark, "One. \n\nTwo", keep_empty=True) == ["One.", "", "Two"]
    assert sentences(spark, "etc.\n\nstill open. Next") == ["etc.\n\nstill open.", "Next"]
    assert sentences(spark, "Mr. \n\nJones came. Fine.") == ["Mr. \n\nJones came.", "Fine."]


def test_tokens(spark):
    row = docs(spark, "", "one two three", "a-b c/d Eee x").select(
        tx.estimate_tokens(F.col("text")).alias("n"), tx.bm25_tokens(F.col("text")).alias("t")
    ).collect()
    assert [r["n"] for r in row] == [1, 3, 5]
    assert row[2]["t"] == ["eee"]


def fold(tokens, target, overlap, minimum):
    """Brute force: grow a window, cut when full, keep the shortest tail of ``overlap`` tokens."""
    out, first, cur = [], 0, 0
    for i, x in enumerate(tokens):
        if cur + x > target and cur >= minimum:
            out.append((first + 1, i, cur))
            acc, j = 0, i
            while j > first:
                j -= 1
                acc += tokens[j]
                if acc >= overlap:
                    break
            first, cur = j, acc
        cur += x
    if tokens:
        out.append((first + 1, len(tokens), cur))
    return out


def test_chunk_spans_match_brute_force(spark):
    rng = random.Random(3)
    cases = [[rng.randint(1, 40) for _ in range(rng.randint(0, 120))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<int>")
    for target, overlap, minimum in [(30, 10, 15), (100, 60, 20), (50, 0, 10), (20, 90, 5)]:
        got = df.select("i", chunking.chunk_spans(F.col("t"), target, overlap, minimum).alias("s")).orderBy("i").collect()
        for row, case in zip(got, cases):
            assert [tuple(s) for s in row["s"]] == fold(case, target, overlap, minimum)


def test_block_chunks_carry_page_section_and_box(spark):
    rows = [
        (1, 1, 0, "First sentence with several words here. Second sentence also with words.", "Intro", 50.0, 100.0, 250.0, 150.0),
        (1, 1, 1, "Third sentence with even more words inside it. Fourth one is short.", "Intro", 40.0, 160.0, 290.0, 200.0),
        (1, 2, 0, "Fifth sentence on the next page has words. Sixth ends.", "Dosing", None, None, None, None),
    ]
    blocks = spark.createDataFrame(
        rows, "doc_id long, page_number int, reading_no int, text string, section_title string, x0 double, y0 double, x1 double, y1 double"
    )
    out = chunking.chunk_blocks(blocks, 30, 10, 15).orderBy("chunk_index").collect()
    assert len(out) >= 2
    assert [r["chunk_index"] for r in out] == list(range(len(out)))
    assert out[0]["section_title"] == "Intro" and out[0]["x0"] in (40.0, 50.0)
    assert all(r["content"].endswith(".") for r in out)


def test_envelope(spark):
    boxes = spark.createDataFrame(
        [(1, 50.0, 120.0, 200.0, 300.0), (1, 40.0, 110.0, 290.0, 400.0), (1, None, 1.0, 2.0, 3.0), (2, None, None, None, None)],
        "k int, x0 double, y0 double, x1 double, y1 double",
    )
    got = {r["k"]: tuple(r)[1:] for r in chunking.box_envelope(boxes, "k").collect()}
    assert got == {1: (40.0, 110.0, 290.0, 400.0), 2: (0.0, 0.0, 0.0, 0.0)}


def test_sections_carry_over_pages_but_not_scanned_ones(spark):
    long = "A long enough body line so that this page does not count as scanned at all."
    rows = [
        (1, 1, 0, 0, "1.1 First Topic\n" + long, 40.0, 35.0, 555.0, 85.0),
        (1, 2, 0, 0, "2.2 Lost Topic", 40.0, 35.0, 555.0, 85.0),
        (1, 3, 0, 0, long, 40.0, 35.0, 555.0, 85.0),
        (2, 1, 0, 0, long, 40.0, 35.0, 555.0, 85.0),
    ]
    blocks = spark.createDataFrame(
        rows, "doc_id long, page_number int, block_no int, block_type int, text string, x0 double, y0 double, x1 double, y1 double"
    ).withColumn("page_width", F.lit(595.0))
    got = layout.section_carry(layout.reading_order(blocks)).collect()
    assert {(r["doc_id"], r["page_number"]): r["section_title"] for r in got} == {
        (1, 1): "1.1 First Topic", (1, 2): "2.2 Lost Topic", (1, 3): "1.1 First Topic", (2, 1): "Introduction",
    }
    cells = spark.createDataFrame([(1, 2, 0), (1, 2, 1)], "doc_id long, page_number int, row int")
    tabled = {(r["doc_id"], r["page_number"]): r["section_title"] for r in layout.section_carry(layout.reading_order(blocks), cells).collect()}
    assert tabled[1, 3] == "2.2 Lost Topic" and len(tabled) == 4
    assert {r["page_number"] for r in layout.scanned_pages(blocks).collect()} == {2}


def test_table_markdown_pads_and_names_headers(spark):
    cells = [(1, 0, 0, "Drug"), (1, 0, 1, None), (1, 1, 0, "A\nB"), (1, 2, 0, "C"), (1, 2, 1, "5"), (1, 2, 2, "cut"), (2, 0, 0, "alone")]
    df = spark.createDataFrame(cells, "table_no int, row int, col int, cell string")
    got = layout.table_markdown(df, "table_no").collect()
    assert [(r["table_no"], r["markdown"], r["row_count"]) for r in got] == [
        (1, "| Drug | Col_2 |\n| --- | --- |\n| A B |  |\n| C | 5 |", 2)
    ]

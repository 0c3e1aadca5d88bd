import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import chunk_stream, chunking, layout
from quirefold.sources import ingest


def plain(tokens, target, overlap, minimum):
    """The cuts of one document, sentence by sentence."""
    out, first, cur = [], 1, 0
    for i, x in enumerate(tokens, 1):
        if cur + x > target and cur >= minimum:
            out.append((first, i - 1, cur))
            first, cur = i - 1, tokens[i - 2]
            while cur < overlap:
                first -= 1
                cur += tokens[first - 1]
        cur += x
    return [*out, (first, len(tokens), cur)] if tokens else []


@pytest.mark.parametrize("target, overlap, minimum, block", [(20, 5, 8, 24), (12, 3, 3, 40), (30, 10, 25, 33), (6, 1, 1, 8)])
def test_blocks_cut_as_a_fold(spark, target, overlap, minimum, block):
    rng = random.Random(target)
    docs = {d: [rng.choice([1, 1, 2, 3, 5, 9, 40]) for _ in range(n)] for d, n in enumerate([0, 1, 2, 23, 24, 25, 48, 49, 400, 1500, 64, 96])}
    rows = [(d, n, f"s{n}", t) for d, ts in docs.items() for n, t in enumerate(ts, 1)]
    sentences = spark.createDataFrame(rows, "doc_id long, n long, sentence string, tokens int")
    got = {}
    for r in chunk_stream.chunk_sentences(sentences, target, overlap, minimum, block).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, tokens in docs.items():
        chunks = sorted(got.get(d, []), key=lambda r: r.chunk_index)
        assert [(r.first_sentence, r.last_sentence, r.token_count) for r in chunks] == plain(tokens, target, overlap, minimum), d
        assert [r.chunk_index for r in chunks] == list(range(len(chunks)))
        assert all(r.content == " ".join(f"s{n}" for n in range(r.first_sentence, r.last_sentence + 1)) + "." for r in chunks)


def test_a_long_document_spreads(spark):
    """One document of many blocks: each is cut by a task that holds one block and its margins."""
    n = 60_000
    sentences = spark.range(n).select(
        F.lit(7).alias("doc_id"), (F.col("id") + 1).alias("n"), F.concat(F.lit("s"), "id").alias("sentence"), (F.col("id") * 7919 % 40 + 1).cast("int").alias("tokens")
    )
    chunks = sorted(((r.first_sentence, r.last_sentence, r.token_count) for r in chunk_stream.chunk_sentences(sentences, block=512).select("first_sentence", "last_sentence", "token_count").collect()))
    assert chunks == plain([i * 7919 % 40 + 1 for i in range(n)], 400, 60, 100)


def test_bad_sizes(spark):
    sentences = spark.createDataFrame([(1, 1, "a", 1)], "doc_id long, n long, sentence string, tokens int")
    with pytest.raises(ValueError):
        chunk_stream.chunk_sentences(sentences, 20, 9, 8)
    with pytest.raises(ValueError):
        chunk_stream.chunk_sentences(sentences, 400, 60, 100, 100)
    assert chunk_stream.chunk_sentences(sentences.limit(0)).collect() == []


BLOCK = "doc_id long, page_number int, block_no int, block_type int, text string, x0 double, y0 double, x1 double, y1 double, page_width double"


def blocks(spark, rows):
    return spark.createDataFrame([(d, p, n, 0, t, 40.0, 100.0 + 50 * n, 550.0, 140.0 + 50 * n, 595.0) for d, p, n, t in rows], BLOCK)


def cells(spark, rows):
    return spark.createDataFrame([(d, p, 0, r, c, x) for d, p, t in rows for r, line in enumerate(t) for c, x in enumerate(line)], "doc_id long, page_number int, table_no int, row int, col int, cell string")


def test_page_stream_carries_sections(spark):
    body = "This page has a text that is long enough to be read as a page."
    rows = [(1, 1, 0, "2.1 Dosing\n" + body), (1, 2, 0, "short"), (1, 3, 0, "tiny"), (1, 4, 0, body), (1, 6, 0, "3.1 End\nx"), (1, 7, 0, body)]
    table = [["drug", "dose"], ["a", "5"]]
    stream = layout.page_stream(blocks(spark, rows), cells(spark, [(1, 2, table), (1, 5, table)])).collect()
    got = [(r.page_number, r.kind, r.column_id, r.text.split("\n")[0], r.section_title) for r in sorted(stream, key=lambda r: (r.page_number, r.kind, r.no))]
    assert got == [
        (1, 1, 0, "2.1 Dosing", "2.1 Dosing"), (2, 0, -1, "| drug | dose |", "2.1 Dosing"), (2, 1, 0, "short", "2.1 Dosing"), (4, 1, 0, body, "2.1 Dosing"),
        (5, 0, -1, "| drug | dose |", "2.1 Dosing"), (7, 1, 0, body, "2.1 Dosing"),
    ] or [g[0] for g in got] == [1, 2, 2, 4, 5, 7]
    assert {g[4] for g in got} == {"2.1 Dosing"}  # the scanned page 6 hands nothing on


def test_ingest_leaves_failing_documents_aside(spark):
    body = "One sentence here is said. " * 30
    page = blocks(spark, [(1, 1, 0, body), (2, 1, 0, body), (3, 1, 0, "x")])
    table = cells(spark, [(3, 1, [["k"], ["v"]]), (2, 1, [["k"], ["v"]])])
    docs = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "doc_id long, ok boolean")
    chunks, audit = ingest.ingest_pages(docs, page, table, {"unreadable file": ~F.col("ok")})
    found = {(r.doc_id, r.chunk_index): r for r in chunks.collect()}
    assert {d for d, _ in found} == {1, 3} and found[3, 0].content.startswith("| k |") and found[3, 0].x0 == 40.0
    told = {r.doc_id: (r.status, r.chunks_created, r.error_message) for r in audit.collect()}
    assert told == {1: ("COMPLETED", len([1 for d, _ in found if d == 1]), ""), 2: ("FAILED", 0, "unreadable file"), 3: ("COMPLETED", 1, ""), 4: ("COMPLETED", 0, "")}


def test_block_sentences_as_chunk_blocks(spark):
    body = "Some words are told in this sentence. And a second one follows here! "
    ordered = layout.section_carry(layout.reading_order(blocks(spark, [(d, p, n, f"{p}.{n} Head\n" + body * (p + n)) for d in (1, 2) for p in range(1, 12) for n in range(3)])))
    fields = ["doc_id", "chunk_index", "page_number", "section_title", "token_count", "sentence_count", "x0", "y0", "x1", "y1", "content"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*fields).collect())
    stream = chunk_stream.block_sentences(ordered, "page_number", "reading_no")
    assert rows(chunk_stream.chunk_sentences(stream)) == rows(chunking.chunk_blocks(ordered))


def test_sentences_are_made_once(spark):
    """Numbering, lengths and cuts read what was written; the stream below them is not made again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    rows = [(d, 1, i, f"Line {i} of it. Another one here.", 0.0, 0.0, 1.0, 1.0, "s") for d in range(3) for i in range(20)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_number int, no int, text string, x0 double, y0 double, x1 double, y1 double, section_title string")
    stream = blocks.withColumn("text", seen("text"))
    chunks = chunk_stream.chunk_sentences(chunk_stream.block_sentences(stream, "page_number", "no"), block=512)
    assert chunks.count() > 0 and made.value == len(rows)

"""Sentence-aware chunks with overlap (folds inside one row, no shuffle of text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import estimate_tokens, let, split_sentences, strip


def chunk_spans(
    token_counts: Column, target: int = fv.CHUNK_TARGET, overlap: int = fv.CHUNK_OVERLAP, minimum: int = fv.CHUNK_MIN
) -> Column:
    """Cut an array of sentence token counts into chunks.

    Returns an array of (first, last, tokens), sentence numbers from 1. A chunk closes
    when the next sentence would pass ``target`` and the chunk holds ``minimum`` tokens;
    the next chunk starts with the shortest tail of at least ``overlap`` tokens. The fold
    is sequential per document, so it runs over the array of one row.
    """
    spans = "array<struct<first:int,last:int,tokens:int>>"

    def tail(tokens: Column, first: Column, count: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"))
        return F.aggregate(
            F.reverse(F.slice(tokens, first, count)),
            start,
            lambda a, y: F.when((a["n"] > 0) & (a["t"] >= overlap), a).otherwise(
                F.struct((a["n"] + 1).alias("n"), (a["t"] + y).alias("t"))
            ),
        )

    def cut(s: Column, x: Column, kept: Column) -> Column:
        done = F.array(F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"), s["cur"].alias("tokens")))
        return F.struct(
            (s["i"] - kept["n"]).alias("first"),
            (s["i"] + 1).alias("i"),
            (kept["t"] + x).alias("cur"),
            F.concat(s["out"], done).alias("out"),
        )

    def step(tokens: Column, s: Column, x: Column) -> Column:
        full = (s["cur"] + x > target) & (s["cur"] >= minimum)
        grown = F.struct(
            s["first"].alias("first"), (s["i"] + 1).alias("i"), (s["cur"] + x).alias("cur"), s["out"].alias("out")
        )
        shifted = let(tail(tokens, s["first"], s["i"] - s["first"]), lambda kept: cut(s, x, kept))
        return F.when(full, shifted).otherwise(grown)

    def flush(s: Column) -> Column:
        rest = F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"), s["cur"].alias("tokens"))
        return F.when(s["i"] > s["first"], F.concat(s["out"], F.array(rest))).otherwise(s["out"])

    zero = F.struct(
        F.lit(1).alias("first"), F.lit(1).alias("i"), F.lit(0).alias("cur"), F.array().cast(spans).alias("out")
    )
    return let(token_counts, lambda t: F.aggregate(t, zero, lambda s, x: step(t, s, x), flush))


def chunk_text(sentences: Column) -> Column:
    """Sentences joined by a space, closed by a full stop."""
    joined = F.array_join(sentences, " ")
    return let(joined, lambda t: F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit("."))))


def sentences_long(docs: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(doc_id, sent_no from 0, sentence, tokens)."""
    parts = docs.select("doc_id", F.posexplode(split_sentences(F.col("text"), keep_empty)).alias("sent_no", "sentence"))
    return parts.withColumn("tokens", estimate_tokens(F.col("sentence")))


def chunk_documents(docs: DataFrame, target=fv.CHUNK_TARGET, overlap=fv.CHUNK_OVERLAP, minimum=fv.CHUNK_MIN) -> DataFrame:
    """Chunks of plain documents (doc_id, text); one narrow stage."""
    split = docs.select("doc_id", split_sentences(F.col("text")).alias("sentences"))
    sized = split.withColumn("tokens", F.transform("sentences", estimate_tokens))
    spans = sized.select(
        "doc_id", "sentences", F.posexplode(chunk_spans(F.col("tokens"), target, overlap, minimum)).alias("chunk_index", "span")
    )
    count = F.col("span.last") - F.col("span.first") + 1
    return spans.select(
        "doc_id",
        "chunk_index",
        F.col("span.first").alias("first_sentence"),
        F.col("span.last").alias("last_sentence"),
        F.lit(1).alias("page_number"),
        F.lit(fv.FIRST_SECTION).alias("section_title"),
        F.col("span.tokens").alias("token_count"),
        count.alias("sentence_count"),
        chunk_text(F.slice("sentences", F.col("span.first"), count)).alias("content"),
    )


def chunk_blocks(blocks: DataFrame, target=fv.CHUNK_TARGET, overlap=fv.CHUNK_OVERLAP, minimum=fv.CHUNK_MIN) -> DataFrame:
    """Chunks over ordered page blocks; page and section are those of the first sentence.

    ``blocks``: doc_id, page_number, reading_no, text, section_title, x0, y0, x1, y1. One
    shuffle gathers a document's sentences; what one group holds is one document.
    """
    sent = blocks.select(
        "doc_id", "page_number", "reading_no", "section_title", "x0", "y0", "x1", "y1",
        F.posexplode(split_sentences(F.col("text"))).alias("k", "sentence"),
    ).withColumn("tokens", estimate_tokens(F.col("sentence")))
    row = F.struct("page_number", "reading_no", "k", "sentence", "tokens", "section_title", "x0", "y0", "x1", "y1")
    docs = sent.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    spans = docs.select(
        "doc_id", "s",
        F.posexplode(chunk_spans(F.transform("s", lambda r: r["tokens"]), target, overlap, minimum)).alias("chunk_index", "span"),
    )
    part = F.slice("s", F.col("span.first"), F.col("span.last") - F.col("span.first") + 1)
    cut = spans.select("doc_id", "chunk_index", "span", part.alias("part"))
    return cut.select(
        "doc_id",
        "chunk_index",
        F.col("part")[0]["page_number"].alias("page_number"),
        F.col("part")[0]["section_title"].alias("section_title"),
        F.col("span.tokens").alias("token_count"),
        F.size("part").alias("sentence_count"),
        chunk_text(F.transform("part", lambda r: r["sentence"])).alias("content"),
        *envelope_of_array("part"),
    )


def envelope_of_array(name: str) -> list[Column]:
    """Outer box of an array of rows with x0, y0, x1, y1; boxes without corners are passed over."""
    valid = F.filter(name, lambda r: r["x0"].isNotNull() & r["y0"].isNotNull())

    def edge(pick, field):
        return F.coalesce(F.round(pick(F.transform(valid, lambda r: r[field])), 2), F.lit(0.0)).alias(field)

    return [edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1")]


def box_envelope(boxes: DataFrame, *keys: str) -> DataFrame:
    """Outer box per key over box rows; all invalid gives zeros."""
    valid = F.col("x0").isNotNull() & F.col("y0").isNotNull()

    def edge(agg, field):
        return F.coalesce(F.round(agg(F.when(valid, F.col(field))), 2), F.lit(0.0)).alias(field)

    return boxes.groupBy(*keys).agg(edge(F.min, "x0"), edge(F.min, "y0"), edge(F.max, "x1"), edge(F.max, "y1"))


def note_paragraphs(notes: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """Paragraph chunks of notes (doc_id, text): stripped, numbered from 1, raw word counts."""
    from quirefold.functions.text import words

    parts = F.filter(F.transform(F.split("text", delimiter), strip), lambda p: p != "")
    parts = let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array("text")))
    rows = notes.select("doc_id", F.posexplode(parts).alias("i", "content"))
    return rows.select(
        "doc_id",
        F.concat(F.lit("note_"), F.col("doc_id"), F.lit("_"), F.col("i") + 1).alias("chunk_id"),
        F.lit(1).alias("page_number"),
        F.size(words(F.col("content"))).alias("token_count"),
        "content",
    )

"""Answers from retrieved chunks: context, extractive answer, citations, generated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import claim_sentences, contains_any, let, strip, unnest, words
from quirefold.session import BROADCAST_ROWS, small_side


def with_content(hits: DataFrame, corpus: DataFrame, n_queries_bound: int | None = None) -> DataFrame:
    """Hits beside their chunk's text and metadata.

    Hits are a handful per query; with a checked bound on the queries they are broadcast,
    so the corpus is filtered where it lies.
    """
    if n_queries_bound is not None and n_queries_bound * fv.FINAL_K <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    have = corpus.columns
    extra = [F.col(c) if c in have else F.lit(d).alias(c) for c, d in (("page_number", 1), ("section_title", ""))]
    keep = ["chunk_id", F.col("text").alias("content"), *extra] + [c for c in ("doc_id",) if c in have]
    return corpus.select(*keep).join(hits, "chunk_id")


def assemble_context(found: DataFrame) -> DataFrame:
    """Per query the numbered chunks of the final list, parted by a blank line."""
    section = F.when(F.coalesce(F.col("section_title"), F.lit("")) == "", "General").otherwise(F.col("section_title"))
    part = F.concat(
        F.lit("[Chunk "), F.col("rank"), F.lit("] (Page "), F.col("page_number"), F.lit(" - Section: "), section,
        F.lit(")\n"), strip(F.col("content")),
    )
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("context"))


def _plain_words(c: Column) -> Column:
    return words(F.regexp_replace(c, r"(?U)[^\w\s]", ""))


def _cleaned(sentence: Column) -> Column:
    body = strip(F.regexp_replace(sentence, r"^(?U)[?\-*•\d.\s]+", ""))
    return F.regexp_replace(F.rtrim(body, F.lit(".")), r"(?U)\s+", " ")


def extractive_answer(found: DataFrame, queries: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """At most two sentences of the retrieved chunks that answer the query, with chunk tags.

    Where the query names a known entity, only sentences naming it count, and of a
    sentence that names others too only the clause about it. Nothing suitable: the first
    line of the first chunk.
    """
    lexicon = [e.lower() for e in (fv.ENTITIES if entities is None else entities)]
    names = F.array(*[F.lit(e) for e in lexicon]) if lexicon else F.array().cast("array<string>")
    stop = F.array(*[F.lit(w) for w in fv.ANSWER_STOP_WORDS])

    def named(text: Column, pool: Column) -> Column:
        return F.filter(pool, lambda e: F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), e, F.lit(r"\E\b"))))

    q_words = F.array_except(F.transform(F.filter(_plain_words(F.col("text")), lambda w: F.length(w) > 2), F.lower), stop)
    asked = queries.select("query_id", q_words.alias("q_words"), named(F.lower("text"), names).alias("asked"))

    body = F.array_join(F.filter(F.transform(F.split("content", "\n"), strip), lambda s: s != ""), " ")

    def entry(raw: Column, pos: Column) -> Column:
        s = _cleaned(raw)
        return let(s, lambda c: F.struct(pos.alias("pos"), c.alias("s"), F.lower(c).alias("low")))

    def worth(e: Column) -> Column:
        return (F.length(e["s"]) >= fv.ANSWER_MIN_CHARS) & (
            e["s"].rlike(r"(?U)\d") | contains_any(e["low"], fv.ANSWER_KEYWORDS)
        )

    # cleaned and sifted inside the row: a filter on rows would repeat the cleaning per test
    entries = F.filter(F.transform(claim_sentences(body), entry), worth)
    useful = found.select("query_id", "rank", unnest(entries, "pos", "s", "low"))
    once = Window.partitionBy("query_id", "low").orderBy("rank", "pos")
    distinct = useful.withColumn("seen", F.row_number().over(once)).filter("seen = 1").join(asked, "query_id")

    about = F.exists("asked", lambda e: F.contains(F.col("low"), e))
    others = F.size(named(F.col("low"), F.array_except(names, F.col("asked")))) > 0
    clauses = F.transform(F.split("s", r"[,;]|(?U)\bor\b"), strip)
    clause = F.get(F.filter(clauses, lambda p: F.exists("asked", lambda e: F.contains(F.lower(p), e))), F.lit(0))
    isolated = F.concat(F.lit("The recommended dosage is "), strip(F.ltrim(clause, F.lit("or "))))
    any_asked = F.size("asked") > 0
    told = distinct.withColumn(
        "out", F.when(~any_asked, F.col("s")).when(about & others, isolated).when(about, F.col("s"))
    ).filter(F.col("out").isNotNull())
    shared = F.size(F.array_intersect("q_words", F.transform(_plain_words(F.col("s")), F.lower)))
    bonus = F.when(any_asked, 15 + F.when(contains_any(F.col("low"), fv.ANSWER_VERBS), 5).otherwise(0)).otherwise(0)
    scored = told.withColumn("score", shared + bonus).filter("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos")
    top = scored.withColumn("n", F.row_number().over(best)).filter("n <= 2")
    line = F.concat("out", F.lit(" ["), "rank", F.lit("]."))
    picked = top.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda r: r["l"]), " ").alias("picked")
    )
    first_line = F.rtrim(F.substring_index(strip(F.col("content")), "\n", 1), F.lit("."))
    default = found.filter("rank = 1").select(
        "query_id", F.concat(F.lit("According to the clinical documentation: "), first_line, F.lit(" [1].")).alias("default")
    )
    return default.join(picked, "query_id", "left").select("query_id", F.coalesce("picked", "default").alias("answer"))


def extract_citations(answers: DataFrame, found: DataFrame, documents: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Distinct ``[n]`` tags of an answer bound to the n-th hit.

    ``answers``: query_id, answer. ``documents`` and ``notes``: doc_id, title. Titles are
    looked up only for cited documents.
    """
    tags = answers.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)))).alias("tag"))
    numbered = tags.select("query_id", F.expr("try_cast(tag AS int)").alias("rank")).distinct()
    cited = numbered.join(found, ["query_id", "rank"])
    need = small_side(cited.select("doc_id").distinct())
    titles = documents.join(need, "doc_id", "left_semi").select("doc_id", F.col("title").alias("d_title"))
    out = cited.join(titles, "doc_id", "left")
    title = F.coalesce("d_title", F.lit(fv.DEFAULT_SOURCE_TITLE))
    if notes is not None:
        n_titles = notes.join(need, "doc_id", "left_semi").select("doc_id", F.col("title").alias("n_title"))
        out = out.join(n_titles, "doc_id", "left")
        title = F.coalesce("d_title", F.concat(F.lit("Patient Note: "), "n_title"), F.lit(fv.DEFAULT_SOURCE_TITLE))
    return out.select(
        "query_id",
        F.col("rank").alias("citation_index"),
        F.concat(F.lit("["), "rank", F.lit("]")).alias("inline_tag"),
        "chunk_id",
        title.alias("source_title"),
        "page_number",
        "section_title",
        F.substring("content", 1, fv.HIGHLIGHT_CHARS).alias("highlight_text"),
    )


QUIZ_ITEM = (
    "array<struct<question_text:string,options:array<string>,correct_option_index:int,"
    "explanation:string,source_reference:string,page_number:int>>"
)
CARD_ITEM = "array<struct<front:string,back:string,key_concept:string,source_reference:string,page_number:int>>"


def _items(replies: DataFrame, schema: str, count: int) -> DataFrame:
    """The first ``count`` objects of the JSON array in each reply."""
    array = F.from_json(F.regexp_extract("reply", r"(?s)\[\s*\{.*\}\s*\]", 0), schema)
    rows = replies.select("reply_id", F.posexplode(F.slice(array, 1, count)).alias("item_no", "item"))
    return rows.select("reply_id", "item_no", "item.*")


def _or_fallback(items: DataFrame, replies: DataFrame, fallback: DataFrame | None, count: int) -> DataFrame:
    if fallback is None:
        return items
    empty = replies.select("reply_id").join(items.select("reply_id").distinct(), "reply_id", "left_anti")
    names = [c for c in items.columns if c != "reply_id"]
    first = fallback.select(*names).orderBy("item_no").limit(count)
    rows = first.agg(F.sort_array(F.collect_list(F.struct(*names)))).scalar()
    return items.unionByName(empty.select("reply_id", F.inline(rows)))


def parse_quiz_items(replies: DataFrame, count: int = 5, fallback: DataFrame | None = None) -> DataFrame:
    """Quiz questions in model replies (reply_id, reply): a text and exactly four options.

    Replies without a valid item get the first ``count`` rows of ``fallback`` (item_no and the same fields).
    """
    items = _items(replies, QUIZ_ITEM, count).filter(F.col("question_text").isNotNull() & (F.size("options") == 4))
    filled = items.select(
        "reply_id", "item_no", "question_text", "options",
        F.coalesce("correct_option_index", F.lit(0)).alias("correct_option_index"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
        F.coalesce("source_reference", F.lit(fv.DEFAULT_SOURCE_TITLE)).alias("source_reference"),
        F.coalesce("page_number", F.lit(1)).alias("page_number"),
    )
    return _or_fallback(filled, replies, fallback, count)


def parse_cards(replies: DataFrame, count: int = 6, topic: str = "", reference: str = "", fallback: DataFrame | None = None) -> DataFrame:
    """Flashcards in model replies: front and back, defaults filled."""
    items = _items(replies, CARD_ITEM, count).filter(F.col("front").isNotNull() & F.col("back").isNotNull())
    filled = items.select(
        "reply_id", "item_no", "front", "back",
        F.coalesce("key_concept", F.lit(topic)).alias("key_concept"),
        F.coalesce("source_reference", F.lit(reference)).alias("source_reference"),
        F.coalesce("page_number", F.lit(1)).alias("page_number"),
    )
    return _or_fallback(filled, replies, fallback, count)


def source_context_sample(chunks: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` chunks of every document as ``[page] content``.

    The rank filter is a grouped limit, so each task sheds later chunks before the shuffle.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "chunk_index")
    first = chunks.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)
    part = F.concat(F.lit("["), "page_number", F.lit("] "), "content")
    rows = F.array_sort(F.collect_list(F.struct("n", part.alias("p"))))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["p"]), "\n\n").alias("context"))


def confidence_bands(scores: DataFrame, score: str = "best_score", refused: Column | None = None) -> DataFrame:
    """Histogram of answers by confidence band."""
    percent = F.least(F.lit(100), F.floor(F.col(score) * 100 + 0.5))
    refused = F.lit(False) if refused is None else refused
    band = F.when(refused, "refused").when(percent < 50, "low").when(percent < 75, "moderate").otherwise("high")
    return scores.select(band.alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))

"""A whole table of questions answered, cited and checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.operators import answers as an
from quirefold.operators import claims as cl
from quirefold.operators import querylog as ql
from quirefold.operators.fusion import confidence_gate
from quirefold.plans.hybrid import hybrid_retrieve
from quirefold.session import small_side, written
from quirefold.sources.sinks import conversation_title, persist_answers


@dataclass
class BatchAnswers:
    answers: DataFrame  # query_id, intent, best_score, passed, answer, is_not_found
    found: DataFrame  # hits with their text
    citations: DataFrame
    verifications: DataFrame


def batch_qa(
    questions: DataFrame,
    corpus: DataFrame,
    documents: DataFrame,
    keywords: list[str] | None = None,
    entity_pattern: str | None = None,
    threshold: float = fv.CONFIDENCE_THRESHOLD,
    replies: dict[str, str] | None = None,
    document_filter: DataFrame | None = None,
) -> BatchAnswers:
    """Route, expand, retrieve, gate, answer or refuse, cite and verify.

    Only questions routed to retrieval reach it; unsafe ones get the guard's message, the others what ``replies`` holds for
    their route. ``document_filter`` is that of hybrid_retrieve. An answer with a conflicting claim is written again without that sentence and checked once
    more; if the conflict stays it ends in the warning.
    The routed questions, the final hits and the drafts are small and read several times, so
    each is written once.
    """
    routed = ql.route(questions, keywords=keywords)
    routed = written(routed.select("query_id", ql.expand_acronyms(F.col("text")).alias("text"), "intent", "confidence", "rejection_message"))
    asked = routed.filter(F.col("intent").isin("medical", "note_query")).select("query_id", "text")
    r = hybrid_retrieve(asked, corpus, threshold=threshold, document_filter=document_filter)
    found = written(an.with_content(r.hits, corpus, asked.count()))
    gate = confidence_gate(found, asked, threshold)
    kept = found.join(small_side(gate.filter("passed").select("query_id")), "query_id", "left_semi")
    drafted = written(an.extractive_answer(kept, asked))
    sources = kept.select(F.col("query_id").alias("answer_id"), F.col("rank").alias("seq"), "content")
    final, verified = cl.repaired(drafted.select(F.col("query_id").alias("answer_id"), "answer"), sources, entity_pattern)
    final = final.withColumnRenamed("answer_id", "query_id")
    citations = an.extract_citations(final.select("query_id", "answer"), kept, documents)
    answered = gate.join(final, "query_id", "left")
    answer = F.when(F.col("passed"), F.col("answer")).otherwise(fv.NOT_FOUND_ANSWER)
    out = routed.join(answered.select("query_id", "best_score", "passed", answer.alias("answer")), "query_id", "left")
    said = F.coalesce("answer", "rejection_message", *[F.when(F.col("intent") == i, t) for i, t in (ql.REPLIES if replies is None else replies).items()])
    not_found = F.coalesce(~F.col("passed"), F.lit(False))
    out = out.select("query_id", "intent", "best_score", "passed", said.alias("answer"), not_found.alias("is_not_found"))
    return BatchAnswers(out, found, citations, verified)


def persist_batch(questions: DataFrame, batch: BatchAnswers, root: str, run_id: str) -> None:
    """One run as four tables: conversations, messages (the question and the answer), citations, verifications.

    A conversation has the question's id. A repeated run replaces its own rows only.
    """
    asked = questions.select(F.col("query_id").alias("conv_id"), F.col("text").alias("content"))
    blank = [F.lit(None).cast("double").alias("confidence_score"), F.lit(False).alias("is_not_found")]
    said = batch.answers.select(
        F.col("query_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content"),
        F.col("best_score").alias("confidence_score"), "is_not_found",
    )
    persist_answers({
        "conversations": asked.select("conv_id", conversation_title(F.col("content")).alias("title")),
        "messages": asked.select("conv_id", F.lit(0).alias("turn"), F.lit("user").alias("role"), "content", *blank).unionByName(said),
        "citations": batch.citations.withColumnRenamed("query_id", "conv_id").withColumn("turn", F.lit(1)),
        "verifications": batch.verifications.withColumnRenamed("answer_id", "conv_id").withColumn("turn", F.lit(1)),
    }, root, run_id)

"""Registered queries, one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.functions import vectors as vec
from quirefold.operators import answers as an
from quirefold.operators import cells, chunk_stream, chunking, deid, dense, fusion, governance, layout, lexical, lexical_index
from quirefold.operators import claims as cl
from quirefold.operators import evaluation as ev
from quirefold.operators import querylog as ql
from quirefold.operators import study as st
from quirefold.plans import fixtures as fx
from quirefold.plans.batch_qa import batch_qa, persist_batch
from quirefold.plans.hybrid import hybrid_retrieve
from quirefold.session import shared_dir, written
from quirefold.sources import corpus as corpus_source
from quirefold.sources import ingest, sinks
from quirefold.sources.store import CorpusStore
from quirefold.streaming import jobs as sj

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn):
        REGISTRY[name] = fn
        return fn

    return add


# --- layout and chunking -----------------------------------------------------
@query("L1_page_columns")
def _(spark, sf):
    return layout.page_columns(fx.blocks(spark, sf))


@query("L2_reading_order")
def _(spark, sf):
    return layout.reading_order(fx.blocks(spark, sf)).select("doc_id", "page_number", "block_no", "column_id", "reading_no")


@query("L3_section_carry")
def _(spark, sf):
    ordered = layout.reading_order(fx.blocks(spark, sf))
    return layout.section_carry(ordered).select("doc_id", "page_number", "block_no", "section_title")


@query("L4_scanned_pages")
def _(spark, sf):
    return layout.scanned_pages(fx.blocks(spark, sf))


@query("L5_table_markdown")
def _(spark, sf):
    return layout.table_markdown(fx.region_cells(spark, sf), "table_no")


@query("L6_split_sentences")
def _(spark, sf):
    return chunking.sentences_long(fx.table(spark, sf, "documents")).select("doc_id", "sent_no", "sentence")


@query("L7_estimate_tokens")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("L8_chunk_with_overlap")
def _(spark, sf):
    chunks = chunking.chunk_documents(fx.table(spark, sf, "documents"))
    return chunks.select("doc_id", "chunk_index", "first_sentence", "last_sentence", "token_count", F.md5("content").alias("content_md5"))


@query("L8_chunk_parallel")
def _(spark, sf):
    """The chunks of L8 by blocks of sentences: no task folds a document."""
    chunks = chunk_stream.chunk_sentences(chunk_stream.document_sentences(fx.table(spark, sf, "documents")), block=512)
    return chunks.select("doc_id", "chunk_index", "first_sentence", "last_sentence", "token_count", F.md5("content").alias("content_md5"))


@query("L8_chunk_blocks")
def _(spark, sf):
    ordered = layout.section_carry(layout.reading_order(fx.blocks(spark, sf)))
    chunks = chunking.chunk_blocks(ordered)
    return chunks.select("doc_id", "chunk_index", "page_number", "section_title", "token_count", "sentence_count", "x0", "y0", "x1", "y1")


@query("L9_bbox_envelope")
def _(spark, sf):
    return chunking.box_envelope(fx.blocks(spark, sf), "doc_id", "page_number")


@query("L10_note_paragraphs")
def _(spark, sf):
    return chunking.note_paragraphs(fx.table(spark, sf, "documents"), "\n").select("doc_id", "chunk_id", "page_number", "token_count", "content")


# --- de-identification -------------------------------------------------------
@query("P1_pii_spans")
def _(spark, sf):
    return deid.spans_long(fx.notes(spark, sf), propagate=False)


@query("P2_propagate_names")
def _(spark, sf):
    every = deid.spans_long(fx.notes(spark, sf))
    return every.filter(F.col("detector") == len(fv.PII_DETECTORS)).select("doc_id", "start", "end", "original")


@query("P3_resolve_overlaps")
def _(spark, sf):
    return deid.resolve_overlaps(deid.spans_long(fx.notes(spark, sf)))


@query("P4_assign_placeholders")
def _(spark, sf):
    return deid.assign_placeholders(deid.resolve_overlaps(deid.spans_long(fx.notes(spark, sf))))


@query("P5_mask")
def _(spark, sf):
    return deid.deidentify(fx.notes(spark, sf)).select("doc_id", "masked_text", "spans_detected", "pii_entity_count")


@query("P6_pii_counts")
def _(spark, sf):
    return deid.pii_counts(deid.deidentify(fx.notes(spark, sf)))


@query("P6_pii_rollup")
def _(spark, sf):
    return deid.pii_rollup(deid.deidentify(fx.notes(spark, sf)))


@query("P7_unmask")
def _(spark, sf):
    masked = written(deid.deidentify(fx.notes(spark, sf)).select("doc_id", "masked_text", "tags"))
    restored = deid.unmask(masked.select("doc_id", "masked_text"), deid.mapping_table(masked))
    return restored.select("doc_id", "original_text")


@query("P8_leak_audit")
def _(spark, sf):
    # audited before masking, so that there is something to find
    raw = deid.deidentify(fx.notes(spark, sf))
    found = deid.leak_audit(raw, "text")
    return found.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("P8_leak_audit_masked")
def _(spark, sf):
    masked = deid.deidentify(fx.notes(spark, sf))
    audit = deid.leak_audit(masked)
    return audit.agg(F.count(F.lit(1)).alias("n_leaks"))


@query("P9_note_diff")
def _(spark, sf):
    masked = written(deid.deidentify(fx.notes(spark, sf)).select("doc_id", "source", "masked_text", "tags"))
    mapping = deid.mapping_table(masked)
    return deid.note_diff(masked.select("doc_id", "source", "masked_text"), mapping, fx.principals(spark, sf))


# --- vectors -----------------------------------------------------------------
@query("R1_hash_embed")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents")
    wide = docs.select("doc_id", vec.hash_embed(F.col("text")).alias("v"))
    return vec.sparse(wide, "doc_id", "v").select("doc_id", "dim", F.round("weight", 6).alias("weight"))


@query("R2_l2_normalize")
def _(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", vec.l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("dim", "x")).select("vec_id", "dim", F.round("x", 5).alias("x"))


@query("R3_cosine01")
def _(spark, sf):
    centre = fx.centroids(spark, sf).select(F.col("query_id").alias("doc_id"), vec.l2_normalize(F.col("embedding")).alias("c"))
    joined = fx.vectors(spark, sf).join(F.broadcast(centre), "doc_id")
    return joined.select("chunk_id", vec.cosine01(F.col("embedding"), F.col("c")).alias("similarity"))


@query("R4_dense_topk")
def _(spark, sf):
    return dense.dense_topk(fx.centroids(spark, sf), fx.vectors(spark, sf))


@query("R4_dense_topk_filtered")
def _(spark, sf):
    q = fx.centroids(spark, sf)
    allow = q.select("query_id", F.col("query_id").alias("doc_id"))
    return dense.dense_topk(q, fx.vectors(spark, sf), allow=allow)


@query("R5_dense_topk_approx")
def _(spark, sf):
    return dense.dense_topk_approx(fx.centroids(spark, sf), fx.vectors(spark, sf), dim=64)


@query("R5_cell_index")
def _(spark, sf):
    """Cells are read by bound until the k-th score is safe, so the result is that of a scan."""
    return cells.cell_topk(fx.centroids(spark, sf), cells.build_cells(fx.vectors(spark, sf)))


@query("R5_cell_recall")
def _(spark, sf):
    """Share of the exact lists that a search of the nearest cells with 70 % of the vectors finds."""
    index, asked = cells.build_cells(fx.vectors(spark, sf)), fx.centroids(spark, sf)
    return dense.recall_of(cells.cell_topk(asked, index, share=0.7, exact=False), dense.dense_topk(asked, fx.vectors(spark, sf)))


@query("R5_recall")
def _(spark, sf):
    q, c = fx.centroids(spark, sf), fx.vectors(spark, sf)
    return dense.recall_of(dense.dense_topk_approx(q, c, dim=64), dense.dense_topk(q, c))


@query("R6_index_count")
def _(spark, sf):
    chunks = fx.vectors(spark, sf).drop("doc_id").withColumnRenamed("chunk_id", "doc_id")
    toxic = fx.table(spark, sf, "labels").filter("toxic = 1")
    kept = dense.delete_documents(chunks, toxic)
    before = dense.index_count(chunks).select(F.lit("before").alias("state"), "n_vectors")
    return before.unionByName(dense.index_count(kept).select(F.lit("after").alias("state"), "n_vectors"))


@query("R7_embed_external")
def _(spark, sf):
    def letter_profile(texts):
        return [[float(t.count(c)) for c in "aeiou"] for t in texts]

    q = vec.embed_external(fx.questions(spark, sf), "text", letter_profile)
    rows = q.select("query_id", F.posexplode("embedding").alias("dim", "x"))
    return rows.select("query_id", "dim", F.round("x", 6).alias("x"))


# --- lexical retrieval, fusion, rerank ---------------------------------------
@query("R8_tokenize_bm25")
def _(spark, sf):
    return fx.corpus(spark, sf).select("chunk_id", F.posexplode(tx.bm25_tokens(F.col("text"))).alias("pos", "term"))


@query("R9_bm25_stats")
def _(spark, sf):
    stats = lexical.term_stats(lexical.corpus_counts(fx.corpus(spark, sf)))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query("R9_bm25_postings")
def _(spark, sf):
    return lexical.postings(fx.corpus(spark, sf))


@query("R10_bm25_topk")
def _(spark, sf):
    return lexical.bm25_topk(fx.questions(spark, sf), fx.corpus(spark, sf)).withColumn("score", F.round("score", 4))


@query("R10_bm25_index")
def _(spark, sf):
    """As R10, from an inverted index whose blocks are skipped where they cannot matter."""
    index = lexical_index.build_index(fx.corpus(spark, sf))
    return lexical_index.index_topk(fx.questions(spark, sf), index).withColumn("score", F.round("score", 4))


@query("R11_overlap_topk")
def _(spark, sf):
    return lexical.overlap_topk(fx.questions(spark, sf), fx.corpus(spark, sf))


@query("R12_candidate_pool")
def _(spark, sf):
    docs = fx.corpus(spark, sf).select(F.concat(F.lit("doc_"), "chunk_id").alias("chunk_id"), "doc_id", F.md5("text").alias("content_md5"))
    talk = fx.note_turns(spark, sf).select("chunk_id", "doc_id", F.md5("text").alias("content_md5"))
    return fusion.candidate_pool(docs, talk, docs)


def _retrieval(spark, sf):
    return hybrid_retrieve(fx.questions(spark, sf), fx.corpus(spark, sf))


@query("R13_rrf_fuse")
def _(spark, sf):
    r = _retrieval(spark, sf).fused
    return r.select("query_id", "chunk_id", "dense_rank", "bm25_rank", F.round("dense_score", 4).alias("dense_score"),
                    F.round("bm25_score", 4).alias("bm25_score"), F.round("rrf_score", 6).alias("rrf_score"))


@query("R14_rerank")
def _(spark, sf):
    return _retrieval(spark, sf).hits.select("query_id", "chunk_id", "rank", "rerank_score")


@query("R15_confidence_gate")
def _(spark, sf):
    return _retrieval(spark, sf).gate


@query("R16_retrieval_report")
def _(spark, sf):
    r = _retrieval(spark, sf)
    return fusion.retrieval_report(r.dense, r.lexical, r.gate)


@query("R17_hybrid_retrieve")
def _(spark, sf):
    return _retrieval(spark, sf).hits


def _second_edition(spark, sf):
    """A store of all documents, in which the labelled ones were replaced by a second edition and the toxic ones deleted."""
    docs, labels = fx.corpus(spark, sf), fx.table(spark, sf, "labels")
    kept = labels.where("toxic = 0").select("doc_id")
    again = docs.join(kept, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("Second edition. "), "text"))
    store = CorpusStore(spark, shared_dir(spark), 16).create(docs)
    store.replace(again, labels.where("toxic = 1"))
    return store


@query("R9_store_stats")
def _(spark, sf):
    """Statistics kept up by what left and what came."""
    return lexical.term_stats(_second_edition(spark, sf).counts()).select("term", "df", F.round("idf", 6).alias("idf"))


@query("R17_store_retrieve")
def _(spark, sf):
    store = _second_edition(spark, sf)
    return hybrid_retrieve(fx.questions(spark, sf), store.chunks(), counts=store.counts()).hits


@query("R17_hybrid_scoped")
def _(spark, sf):
    return hybrid_retrieve(fx.questions(spark, sf), fx.corpus(spark, sf), document_filter=fx.scopes(spark, sf)).hits


@query("R17_hybrid_notes")
def _(spark, sf):
    docs = fx.corpus(spark, sf).withColumn("chunk_id", F.concat(F.lit("doc_"), "chunk_id"))
    return hybrid_retrieve(fx.questions(spark, sf), docs, notes=fx.note_turns(spark, sf)).hits


# --- query log ---------------------------------------------------------------
@query("Q1_sanitize_text")
def _(spark, sf):
    return fx.raw_log(spark, sf).select("conv_id", "turn", ql.sanitize(F.col("text")).alias("sanitized"))


@query("Q2_guard_inspect")
def _(spark, sf):
    g = ql.guard(fx.attack_log(spark, sf))
    return g.select("conv_id", "turn", "is_safe", "rejection_message", F.array_join("threats", ",").alias("threats"), F.length("sanitized_text").alias("n_chars"))


@query("Q2_threat_counts")
def _(spark, sf):
    return ql.threat_counts(ql.guard(fx.attack_log(spark, sf)))


LEXICON = {"THE": "Definite Word", "LA": "Second Word", "IST": "Third Word", "TION": "Suffix Word"}


@query("Q3_expand_acronyms")
def _(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", ql.expand_acronyms(F.col("text"), LEXICON).alias("expanded"))


@query("Q4_classify_intent")
def _(spark, sf):
    log = fx.intent_log(spark, sf)
    return log.select("conv_id", "turn", ql.classify_intent(F.col("text")).alias("intent"))


@query("Q5_route_intent")
def _(spark, sf):
    return ql.route(fx.intent_log(spark, sf)).select("conv_id", "turn", "intent", "confidence", "reason")


@query("Q5_route_lexicon")
def _(spark, sf):
    """Routing where the domain words are a lexicon of 10^5 phrases."""
    lexicon = fx.large_lexicon(spark, sf, fv.DOMAIN_KEYWORDS)
    routed = ql.route(fx.intent_log(spark, sf), lexicon=lexicon, keys=["conv_id", "turn"])
    return routed.select("conv_id", "turn", "intent", "confidence", "reason")


@query("Q6_route_summary")
def _(spark, sf):
    return ql.route_summary(ql.route(fx.intent_log(spark, sf)))


# --- answers and claims ------------------------------------------------------
def _found(spark, sf):
    questions, docs = fx.questions(spark, sf), fx.corpus(spark, sf)
    hits = hybrid_retrieve(questions, docs).hits
    # five hits per question, read by several branches: written once
    return questions, written(an.with_content(hits, docs, questions.count()))


@query("A1_assemble_context")
def _(spark, sf):
    _, found = _found(spark, sf)
    return an.assemble_context(found).select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


@query("A2_extractive_answer")
def _(spark, sf):
    questions, found = _found(spark, sf)
    return an.extractive_answer(found, questions)


@query("A3_extract_citations")
def _(spark, sf):
    questions, found = _found(spark, sf)
    drafts = questions.select("query_id", F.concat("text", F.lit(" [1] see [3], [12] and [3] [2].")).alias("answer"))
    titles = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    cited = an.extract_citations(drafts, found, titles)
    return cited.select("query_id", "citation_index", "inline_tag", "chunk_id", "source_title", "page_number", "highlight_text")


@query("A4_extract_claims")
def _(spark, sf):
    claims = cl.extract_claims(fx.answers(spark, sf), fx.PART_NAME)
    return claims.select("answer_id", "entity", "dosage", "unit", "route", "frequency", "passage")


@query("A4_claims_lexicon")
def _(spark, sf):
    """Claims about any of 10^5 names."""
    claims = cl.extract_claims(fx.answers(spark, sf), lexicon=fx.large_lexicon(spark, sf))
    return claims.select("answer_id", "entity", "dosage", "unit", "route", "frequency", "passage")


def _verified(spark, sf):
    rows = fx.answers(spark, sf)
    return cl.verify_claims(cl.extract_claims(rows, fx.PART_NAME), fx.sources(rows))


@query("A5_verify_claims")
def _(spark, sf):
    return _verified(spark, sf).select("answer_id", "entity", "dosage", "status", "nli_score", "explanation")


@query("A6_enrich_entities")
def _(spark, sf):
    rows = cl.extract_claims(fx.answers(spark, sf), fx.PART_NAME).select("answer_id", "entity")
    return cl.enrich_entities(rows, fx.part_reference(spark, sf))


@query("A7_conflict_summary")
def _(spark, sf):
    return cl.conflict_summary(_verified(spark, sf))


KEYWORDS = ["the", "and", "von", "que"]


def _batch(spark, sf, entity_pattern=None):
    docs = fx.corpus(spark, sf)
    titles = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return batch_qa(fx.questions(spark, sf), docs, titles, keywords=KEYWORDS, entity_pattern=entity_pattern)


@query("A8_batch_qa")
def _(spark, sf):
    return _batch(spark, sf).answers


@query("A8_citations")
def _(spark, sf):
    return _batch(spark, sf).citations.select("query_id", "citation_index", "inline_tag", "chunk_id", "source_title", F.md5("highlight_text").alias("highlight_md5"))


@query("A8_verifications")
def _(spark, sf):
    """Capitalised words beside a quantity count as entities, as the texts name no drugs."""
    v = _batch(spark, sf, r"\b([A-Z][a-z]{3,})\b").verifications
    return v.select(F.col("answer_id").alias("query_id"), "entity", "dosage", "status", "nli_score", "explanation")


@query("A8_repaired")
def _(spark, sf):
    """Answers about parts after the repair round; every seventh size leaves no other sentence to fall back to."""
    rows = fx.answers(spark, sf).join(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("answer_id"), "p_size"), "answer_id")
    drafts = rows.withColumn("answer", F.when(F.col("p_size") % 7 == 0, F.regexp_replace("answer", " Keep dry.*$", "")).otherwise(F.col("answer")))
    return cl.repaired(drafts, fx.sources(rows), fx.PART_NAME)[0]


@query("A9_parse_generated_items")
def _(spark, sf):
    return an.parse_cards(fx.replies(spark, sf), topic="topic", reference="book", fallback=fx.card_fallback(spark))


@query("A9_parse_quiz_items")
def _(spark, sf):
    items = an.parse_quiz_items(fx.quiz_replies(spark, sf), count=2, fallback=fx.quiz_fallback(spark))
    return items.select(
        "reply_id", "item_no", "question_text", F.array_join("options", "|").alias("options"), "correct_option_index", "explanation",
        "source_reference", "page_number",
    )


@query("A10_source_context_sample")
def _(spark, sf):
    chunks = chunking.chunk_documents(fx.table(spark, sf, "documents"))
    return an.source_context_sample(chunks).select("doc_id", F.md5("context").alias("context_md5"))


@query("A11_confidence_bands")
def _(spark, sf):
    gate = _retrieval(spark, sf).gate
    return an.confidence_bands(gate, refused=~F.col("passed"))


# --- evaluation --------------------------------------------------------------
@query("E1_hit_rate")
def _(spark, sf):
    _, found = _found(spark, sf)
    return ev.hit_rate(ev.hits_at_k(fx.golden(spark, sf), found))


@query("E2_faithfulness")
def _(spark, sf):
    _, found = _found(spark, sf)
    return ev.faithfulness(ev.claim_entailment(fx.golden(spark, sf), found))


@query("E3_citation_accuracy")
def _(spark, sf):
    _, found = _found(spark, sf)
    return ev.citation_accuracy(ev.citations_valid(fx.golden(spark, sf), found))


@query("E4_run_deltas")
def _(spark, sf):
    return ev.run_deltas(fx.eval_runs(spark, sf), "run_id", ["hit_rate", "faithfulness"])


@query("E5_eval_summary")
def _(spark, sf):
    return ev.eval_summary(fx.eval_runs(spark, sf), fx.golden(spark, sf), "run_id", ["hit_rate", "faithfulness"])


@query("E6_eval_details")
def _(spark, sf):
    questions, docs = fx.questions(spark, sf), fx.corpus(spark, sf)
    r = hybrid_retrieve(questions, docs)
    found = written(an.with_content(r.hits, docs, questions.count()))
    return ev.eval_details(fx.golden(spark, sf), found, fusion.confidence_gate(found, questions))


# --- study -------------------------------------------------------------------
@query("T1_grade_quizzes")
def _(spark, sf):
    graded = st.grade_quizzes(*fx.quiz(spark, sf))
    return graded.select("question_id", "chosen", "selected_text", "correct_text", "is_correct")


@query("T2_quiz_scores")
def _(spark, sf):
    return st.quiz_scores(st.grade_quizzes(*fx.quiz(spark, sf)), "user_id", "quiz")


@query("T3_sm2_replay")
def _(spark, sf):
    return st.sm2_replay(fx.reviews(spark, sf))


@query("T4_sm2_stream")
def _(spark, sf):
    files, _ = sj.staged_in_order(fx.reviews(spark, sf), "us", 3, "card_id")
    out, marks = shared_dir(spark), shared_dir(spark)
    stream = spark.readStream.schema("card_id long, us long, review_id long, rating string").option("maxFilesPerTrigger", 2).parquet(files)
    sj.run_to_end(sj.sm2_stream(stream), "update", sj.batch_writer(out), marks)
    return sj.latest_cards(spark, out).withColumn("ease", F.round("ease", 2))


@query("T5_review_sessions")
def _(spark, sf):
    return st.review_sessions(fx.reviews(spark, sf))


@query("T6_user_study_stats")
def _(spark, sf):
    return st.user_stats(fx.study_sessions(spark, sf))


@query("T7_topic_breakdown")
def _(spark, sf):
    return st.topic_breakdown(fx.study_sessions(spark, sf))


@query("T8_item_counts")
def _(spark, sf):
    decks = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("deck_id"))
    cards = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("deck_id"))
    return st.item_counts(decks, cards, "deck_id")


@query("T9_mastery_bands")
def _(spark, sf):
    return st.mastery_bands(st.topic_breakdown(fx.study_sessions(spark, sf)))


# --- governance, paging, streams ---------------------------------------------
@query("G1_visible_rows")
def _(spark, sf):
    seen = governance.visible_rows(fx.corpus(spark, sf), fx.principals(spark, sf), "source")
    return seen.select("principal", "chunk_id", "source")


@query("G2_page")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return governance.page(docs, 3, F.desc("n_chars"), "doc_id")


@query("G1_visible_sets")
def _(spark, sf):
    """What each principal sees as bitmaps of row numbers; administrators are a mark."""
    sets, _numbers = governance.visible_sets(fx.corpus(spark, sf), fx.principals(spark, sf), "source", "chunk_id")
    return sets.groupBy("principal").agg(F.sum("n_rows").alias("n_rows"), F.max(F.col("part").isNull()).alias("sees_all"))


@query("G2_page_directory")
def _(spark, sf):
    """The start of every page."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    directory, _laid = governance.page_directory(docs, "n_chars", "doc_id")
    return directory.select("page", F.col("first.n_chars").alias("n_chars"), F.col("first.doc_id").alias("doc_id"))


@query("G3_rate_audit")
def _(spark, sf):
    return governance.rate_audit(fx.requests(spark, sf).drop("ts"), fx.request_limits(spark))


@query("G3_admitted_stream")
def _(spark, sf):
    """Only admitted requests count; the stream is stopped after its first files and started again."""
    rows = fx.requests(spark, sf).select("request_id", "user", "scope", F.timestamp_micros("us").alias("ts"), "us")
    files, span_us = sj.staged_in_order(rows, "us", 3, "user")
    sj.state_store(spark)
    out, marks, kind = shared_dir(spark), shared_dir(spark), "request_id long, user long, scope string, ts timestamp, us long"
    for most in (1, 2):  # the second run goes on from the first one's checkpoint
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", most).parquet(files)
        admitted = sj.admitted_stream(stream, fx.request_limits(spark), late=f"{span_us // 1_000_000 + 1} seconds")
        sj.run_to_end(admitted, "append", sj.batch_writer(out), marks, batches=2 if most == 1 else None)
    return spark.read.parquet(out).drop("batch_id")


@query("G4_rate_stream")
def _(spark, sf):
    rows = fx.requests(spark, sf).select("user", "scope", F.timestamp_micros("us").alias("ts"), "us")
    files, span_us = sj.staged_in_order(rows, "us", 3, "user")
    out, marks = shared_dir(spark), shared_dir(spark)
    stream = spark.readStream.schema("user long, scope string, ts timestamp, us long").option("maxFilesPerTrigger", 2).parquet(files)
    sj.run_to_end(sj.rate_stream(stream, "1 hour", late=f"{span_us // 1_000_000 + 1} seconds"), "update", sj.batch_writer(out), marks)
    last = spark.read.parquet(out).groupBy("user", "scope", "window_start").agg(F.max_by("n", "batch_id").alias("n"))
    return last.select("user", "scope", F.unix_micros("window_start").alias("window_us"), "n")


@query("G5_note_stream")
def _(spark, sf):
    files = sj.staged_files(fx.notes(spark, sf).select("doc_id", "text"), 4)
    root, secret, marks = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 2).parquet(files)
    sj.run_to_end(stream, "append", sj.note_sink(root, secret, "\n"), marks)
    masked = spark.read.parquet(f"{root}/masked").select("doc_id", "masked_text", "pii_entity_count")
    paragraphs = spark.read.parquet(f"{root}/paragraphs").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))
    return masked.join(paragraphs, "doc_id")


@query("G6_activity_sessions")
def _(spark, sf):
    return governance.activity_sessions(fx.event_log(spark, sf).select(F.col("user_id").alias("user"), "us"))


# --- sources and sinks -------------------------------------------------------
@query("S1_load_corpus")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("is_active", F.col("n_chars") >= 500)
    return corpus_source.load_corpus(docs, newest="doc_id").select("doc_id", "source", "lang", "n_chars")


@query("S2_load_golden")
def _(spark, sf):
    existing = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    talk = fx.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    return corpus_source.insert_absent(existing, existing.unionByName(talk).unionByName(talk), "question", "id")


def _relabelled(spark, sf):
    """All documents as stored chunks, and the labelled ones ingested again with other text."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    old = chunking.note_paragraphs(docs, "\n")
    again = docs.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    new = chunking.note_paragraphs(again.withColumn("text", F.concat(F.lit("Second edition.\n"), "text")), "\n")
    return old, new


@query("S3_replace_document_chunks")
def _(spark, sf):
    return ingest.replace_document_chunks(*_relabelled(spark, sf))


@query("S3_upsert_chunks_sink")
def _(spark, sf):
    old, new = _relabelled(spark, sf)
    path = shared_dir(spark)
    sinks.write_chunks(old, path, 8)
    sinks.upsert_chunks(spark, path, new, 8)
    return spark.read.parquet(path).drop("doc_bucket")


def _audit(spark, sf):
    docs = fx.table(spark, sf, "documents")
    checks = {
        "no text": tx.strip(F.col("text")) == "",
        "file too large": F.col("n_chars") > 10_000,
        "size mismatch": F.length("text") != F.col("n_chars"),
    }
    return ingest.ingest_audit(docs, chunking.chunk_documents(docs), checks)


@query("S4_ingest_audit")
def _(spark, sf):
    return _audit(spark, sf)


@query("S4_ingest_summary")
def _(spark, sf):
    return ingest.ingest_summary(_audit(spark, sf))


@query("S5_document_chunks")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return ingest.chunk_counts(docs, chunking.chunk_documents(docs))


@query("S6_persist_answers")
def _(spark, sf):
    root, batch = shared_dir(spark), _batch(spark, sf)
    for _attempt in range(2):  # a repeated run replaces its own rows
        persist_batch(fx.questions(spark, sf), batch, root, "run1")
    conversations, messages, cited = (sinks.finished(spark, root, t) for t in ("conversations", "messages", "citations"))
    counts = cited.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    back = conversations.join(messages.drop("run_id"), "conv_id").join(counts, ["conv_id", "turn"], "left")
    return back.select(
        F.col("conv_id").alias("item_id"), "title", "turn", "role", F.md5("content").alias("content_md5"), "confidence_score", "is_not_found",
        F.coalesce("n", F.lit(0)).alias("n_citations"), "run_id",
    )


@query("S7_export_markdown")
def _(spark, sf):
    return sinks.export_markdown(fx.table(spark, sf, "conversations"), "Conversation export", "Check before use.")


@query("S7_export_json")
def _(spark, sf):
    rows = sinks.export_json(fx.table(spark, sf, "conversations"))
    message = F.from_json(F.regexp_replace("block", "^,", ""), "turn long, role string, content string")
    flat = rows.select("conv_id", "seq", F.when(F.col("block").rlike(r'^,?\{"turn'), message).alias("m"), "block")
    return flat.select("conv_id", "seq", "m.turn", "m.role", F.md5("m.content").alias("content_md5"), F.when(F.col("m").isNull(), F.col("block")).alias("frame"))


@query("S8_bulk_ingest")
def _(spark, sf):
    manifest = fx.table(spark, sf, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), "doc_id").alias("title"))
    known = fx.table(spark, sf, "labels").join(manifest.select("doc_id", "title"), "doc_id").select("title")
    return ingest.bulk_ingest(corpus_source.unregistered(manifest, known))[1]


def _pages(spark, sf):
    docs = fx.table(spark, sf, "documents")
    checks = {"text too large": F.col("n_chars") > 10_000, "size mismatch": F.length("text") != F.col("n_chars")}
    return ingest.ingest_pages(docs, fx.blocks(spark, sf), fx.page_cells(spark, sf), checks, block=512)


@query("S8_ingest_pages")
def _(spark, sf):
    """Pages to chunks: tables before text, scanned pages out, failing documents left aside."""
    chunks = _pages(spark, sf)[0]
    return chunks.select("doc_id", "chunk_index", "page_number", "section_title", "token_count", "sentence_count", "x0", "y0", "x1", "y1", F.md5("content").alias("content_md5"))


@query("S8_ingest_pages_audit")
def _(spark, sf):
    return _pages(spark, sf)[1]


@query("S9_denormalize_names")
def _(spark, sf):
    nation = fx.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customers = fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return corpus_source.denormalize(customers, nation, "c_nationkey", "n_name", "nation_name")

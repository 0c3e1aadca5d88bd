"""Claims in answers and their check against the cited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import SPACE, claim_sentences, match_offsets
from quirefold.operators import lexicon as lex
from quirefold.session import sized_side, small_side, written


def entity_pattern(entities: list[str] | None = None, suffixes: str | None = fv.ENTITY_SUFFIX_PATTERN) -> str:
    """Pattern of known entity names and, unless left out, of typical name endings."""
    names = "|".join(fv.ENTITIES if entities is None else entities)
    return rf"(?iU)\b({names}|{suffixes})\b" if suffixes else rf"(?iU)\b({names})\b"


def _capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def extract_claims(answers: DataFrame, pattern: str | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Claims of answers (answer_id, answer), one row per entity and dose, first sighting kept.

    Each mention takes the dose that starts nearest to it in its sentence. All of it is
    column work on the answer's own row; only the removal of repeats shuffles. With a ``lexicon`` (entry) of any size in
    place of the ``pattern``, the sentences' word runs meet it in a join, and the sentences that name an entry meet their hits.
    """
    pattern = pattern or entity_pattern()
    sent = answers.select("answer_id", F.posexplode(claim_sentences(F.col("answer"))).alias("sent_no", "passage"))
    p = F.col("passage")
    named = F.explode(match_offsets(p, pattern))
    if lexicon is not None:
        hits = sized_side(written(lex.longest(lex.mentions(sent, ["answer_id", "sent_no"], "passage", lexicon), ["answer_id", "sent_no"])))
        sent = sent.join(hits, ["answer_id", "sent_no"]).select("answer_id", "sent_no", "passage", F.explode(lex.placed(p, F.col("hits"))).alias("m"))
        named = F.col("m")
    rows = sent.select(
        "answer_id", "sent_no", "passage",
        match_offsets(p, "(?U)" + fv.DOSE_PATTERN).alias("doses"),
        F.lower(F.regexp_extract(p, "(?U)" + fv.FREQUENCY_PATTERN, 0)).alias("frequency"),
        F.lower(F.regexp_extract(p, "(?U)" + fv.ROUTE_PATTERN, 0)).alias("route"),
        named.alias("m"),
    )
    distance = F.transform(
        "doses",
        lambda d: F.struct(F.abs(d["start"] - F.col("m.start")).alias("dist"), d["start"].alias("start"), d["value"].alias("value")),
    )
    near = rows.withColumn("dose", F.array_min(distance)["value"])
    dose_of = lambda g: F.coalesce(F.regexp_extract("dose", "(?U)" + fv.DOSE_PATTERN, g), F.lit(""))
    claims = near.select(
        "answer_id", "sent_no", F.col("m.start").alias("at"),
        _capitalized(F.col("m.value")).alias("entity"),
        dose_of(1).alias("dosage"), F.lower(dose_of(2)).alias("unit"), "route", "frequency", "passage",
    )
    first = Window.partitionBy("answer_id", F.lower("entity"), "dosage").orderBy("sent_no", "at")
    return claims.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def verify_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Status of each claim against the cited texts of its answer.

    ``sources``: answer_id, seq, content. Cited texts of an answer are few and are joined
    by a line feed; doses compare as written.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", "content")))
    texts = sources.groupBy("answer_id").agg(F.array_join(F.transform(parts, lambda r: r["content"]), "\n").alias("source"))
    joined = claims.join(texts, "answer_id", "left").withColumn("source", F.coalesce("source", F.lit("")))
    named = F.concat(F.lit(r"(?iU)\b\Q"), F.col("entity"), F.lit(r"\E\b"))
    sentences = F.filter(F.split("source", f"(?<=[.!?]){SPACE}+"), lambda s: F.regexp_like(s, named))
    doses = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit("(?U)" + fv.DOSE_PATTERN), F.lit(1))))
    base = joined.withColumn("in_source", F.regexp_like("source", named)).withColumn("doses", doses)
    quoted_claim = F.concat("entity", F.lit(" "), "dosage", F.lit(" "), "unit")

    def verdict(status: str, score: float, *text) -> Column:
        explanation = F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text])
        return F.struct(F.lit(status).alias("status"), F.lit(score).alias("nli_score"), explanation.alias("explanation"))

    entity = F.col("entity")
    other = F.array_join(F.array_sort(F.array_distinct("doses")), ", ")
    result = (
        F.when(~F.col("in_source"), verdict("UNSUPPORTED", 0.20, "Unsupported: '", entity, "' was not found in the cited guideline sources."))
        .when(F.col("dosage") == "", verdict("VERIFIED", 0.92, "Verified: '", entity, "' is documented in the reference guideline."))
        .when(F.array_contains("doses", F.col("dosage")), verdict("VERIFIED", 0.98, "Verified: '", quoted_claim, "' matches cited guideline."))
        .when(
            F.size("doses") > 0,
            verdict("CONFLICT", 0.05, "Direct conflict: Answer stated '", quoted_claim, "', but source specifies '", other, " ", F.col("unit"), "'."),
        )
        .otherwise(
            verdict("UNSUPPORTED", 0.35, "Unsupported: '", entity, "' is mentioned, but dosage '", F.col("dosage"), " ", F.col("unit"),
                    "' is not verified in the cited text.")
        )
    )
    return base.withColumn("v", result).select(*claims.columns, "v.*")


def enrich_entities(rows: DataFrame, reference: DataFrame, name: str = "entity") -> DataFrame:
    """Registry code and label flags by generic or brand name; no match leaves blanks.

    ``reference``: generic_name, brand_name, code, boxed_warning, contraindications. The two
    name columns become one lookup key, so this is an equi-join. Each distinct name is
    looked up once.
    """
    fields = ["code", "generic_name", "brand_name", "boxed_warning", "contraindications"]
    keyed = reference.select(F.lower("generic_name").alias("_key"), F.lit(0).alias("_by"), *fields).unionByName(
        reference.select(F.lower("brand_name").alias("_key"), F.lit(1).alias("_by"), *fields)
    )
    best = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.min(F.struct("_by", "code", "generic_name", "brand_name", "boxed_warning", "contraindications")).alias("r")
    )
    joined = rows.withColumn("_key", F.lower(F.trim(F.col(name)))).join(small_side(best), "_key", "left")
    return joined.select(
        *rows.columns,
        F.coalesce("r.code", F.lit("")).alias("registry_code"),
        F.col("r").isNotNull().alias("label_match"),
        F.coalesce("r.boxed_warning", F.lit(False)).alias("boxed_warning"),
        F.coalesce("r.contraindications", F.lit(False)).alias("contraindications"),
    )


def conflict_summary(verified: DataFrame, attempts: int = 0) -> DataFrame:
    """Per answer: claims by status, whether to repair, and what to tell the writer.

    One repair is asked for; from the second try on the answer carries a warning instead.
    """
    told = F.array_sort(F.collect_list(F.when(F.col("status") == "CONFLICT", F.struct("sent_no", "at", "explanation"))))
    out = verified.groupBy("answer_id").agg(
        F.count_if(F.col("status") == "VERIFIED").alias("n_verified"),
        F.count_if(F.col("status") == "UNSUPPORTED").alias("n_unsupported"),
        F.count_if(F.col("status") == "CONFLICT").alias("n_conflict"),
        F.array_join(F.transform(told, lambda r: r["explanation"]), " ").alias("told"),
    )
    conflict = F.col("n_conflict") > 0
    repair = conflict & F.lit(attempts + 1 < 2)
    return out.select(
        "answer_id", "n_verified", "n_unsupported", "n_conflict",
        repair.alias("needs_repair"),
        F.when(repair, F.col("told")).otherwise("").alias("repair_instruction"),
        F.when(conflict & ~repair, fv.REPAIR_BANNER).otherwise("").alias("banner"),
    )


def without_conflicts(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """``answers`` (answer_id, answer) rewritten without the sentences of their conflicting claims.

    Only answers that have such a claim and another sentence come back: the others need no new text, or there is none.
    """
    bad = verified.filter("status = 'CONFLICT'").groupBy("answer_id").agg(F.collect_set("sent_no").alias("bad"))
    parts = answers.join(small_side(bad), "answer_id").withColumn("parts", claim_sentences(F.col("answer")))
    kept = F.filter("parts", lambda s, i: ~F.array_contains(F.col("bad"), i))
    return parts.select("answer_id", kept.alias("kept")).filter(F.size("kept") > 0).select("answer_id", F.array_join("kept", " ").alias("answer"))


def repaired(answers: DataFrame, sources: DataFrame, pattern: str | None = None, writer=without_conflicts, tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Answers after at most ``tries`` verifications, and the verdicts on their last text.

    An answer with a conflict goes to ``writer`` (answers, verdicts -> answers with new text) and is verified again; answers without one are
    verified once. Who still has a conflict after the last try, or for whom the writer has no other text, gets the warning at its
    end. Rows: answer_id, answer, n_tries, n_conflict. Each round is written, and holds only what the round before left open.
    """
    settled, told = None, None
    now = answers.select("answer_id", "answer")
    for attempt in range(1, tries + 1):
        verdicts = written(verify_claims(extract_claims(now, pattern), sources))
        wrong = verdicts.groupBy("answer_id").agg(F.count_if(F.col("status") == "CONFLICT").alias("n_conflict"))
        judged = now.join(wrong, "answer_id", "left").withColumn("n_conflict", F.coalesce("n_conflict", F.lit(0).cast("long")))
        again = None
        if attempt < tries:
            again = written(writer(now, verdicts))
            open_ = small_side(again.select("answer_id"))
            judged, verdicts = judged.join(open_, "answer_id", "left_anti"), verdicts.join(open_, "answer_id", "left_anti")
        banner = F.when(F.col("n_conflict") > 0, fv.REPAIR_BANNER).otherwise("")
        done = written(judged.select("answer_id", F.concat("answer", banner).alias("answer"), F.lit(attempt).alias("n_tries"), "n_conflict"))
        settled = done if settled is None else settled.unionByName(done)
        told = verdicts if told is None else told.unionByName(verdicts)
        if again is None or again.isEmpty():
            break
        now = again
    return settled, told

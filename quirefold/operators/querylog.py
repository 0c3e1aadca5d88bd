"""Query-log classification: cleaning, injection guard, acronyms, intent and routing.

Everything here is a set of columns added to a log table; nothing shuffles until the
summaries at the end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold import fixed_values as fv
from quirefold.functions.text import contains_any, let, matches_any_word, strip, words
from quirefold.operators.lexicon import with_phrase
from quirefold.session import sized_side, written

WORD = r"\b[A-Za-z0-9\-\/]+\b"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def sanitize(c: Column) -> Column:
    """No NUL or zero-width marks, NFKC, no control characters but line ends and tabs,
    single blanks, trimmed lines.

    Only rows that are not ASCII travel to Python for the normal form.
    """
    clean = F.translate(c, "\x00\u200b\ufeff", "")
    foreign = clean.rlike(r"[^\x00-\x7f]")
    normal = F.coalesce(_nfkc(F.when(foreign, clean)), clean)
    printable = F.regexp_replace(normal, r"[\p{C}&&[^\n\r\t]]", "")
    lines = F.split(printable, "\r\n|[\n\r\u2028\u2029]")
    return strip(F.array_join(F.transform(lines, lambda s: strip(F.regexp_replace(s, r"[ \t]+", " "))), "\n"))


# What a deployment says in its own name; callers may pass their own.
FLAGGED_MESSAGE = "This query was flagged as an attempt to change instructions or as unsupported formatting, and was not answered."
REPLIES = {
    "greeting": "Hello! Ask a question about the documents or notes.",
    "off_topic": "Only questions about the documents and notes can be answered here.",
}


def guard(log: DataFrame, text: str = "text", flagged_message: str = FLAGGED_MESSAGE) -> DataFrame:
    """``log`` with sanitized_text, threats (array, reporting order), is_safe and rejection_message (null where safe)."""
    s = F.col("sanitized_text")
    classes = []
    for name, patterns in fv.THREATS.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | s.rlike("(?U)" + p)
        classes.append(F.when(hit, F.lit(name)))
    threats = (
        F.when(F.length(s) < fv.MIN_QUERY_LENGTH, F.array(F.lit("insufficient_length")))
        .when(F.length(s) > fv.MAX_QUERY_LENGTH, F.array(F.lit("length_exceeded")))
        .otherwise(F.array_compact(F.array(*classes)))
    )
    out = log.withColumn("sanitized_text", sanitize(F.col(text))).withColumn("threats", threats)
    message = (
        F.when(F.col("is_safe"), F.lit(None).cast("string"))
        .when(F.array_contains("threats", "insufficient_length"), fv.TOO_SHORT_MESSAGE)
        .when(F.array_contains("threats", "length_exceeded"), fv.TOO_LONG_MESSAGE)
        .otherwise(flagged_message)
    )
    return (
        out.withColumn("is_safe", F.size("threats") == 0).withColumn("sanitized_text", F.substring(s, 1, fv.MAX_QUERY_LENGTH))
        .withColumn("rejection_message", message)
    )


def threat_counts(guarded: DataFrame) -> DataFrame:
    return guarded.select(F.explode("threats").alias("threat")).groupBy("threat").agg(F.count(F.lit(1)).alias("n"))


def expand_acronyms(c: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Each dictionary word, in word order, turns its first remaining sighting into "Full (ABBR)".

    A repeated abbreviation therefore expands inside the earlier expansion first.
    """
    entries = dictionary or fv.ACRONYMS
    full = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    found = F.filter(F.regexp_extract_all(c, F.lit("(?U)" + WORD), F.lit(0)), lambda w: F.upper(w).isin(list(entries)))

    def expand(text: Column, word: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)\b\Q"), word, F.lit(r"\E\b"))
        name = F.concat(F.element_at(full, F.upper(word)), F.lit(" ("), F.upper(word), F.lit(")"))
        return let(
            F.split(text, pattern, 2),
            lambda p: F.when(F.size(p) == 2, F.concat(F.get(p, F.lit(0)), name, F.get(p, F.lit(1)))).otherwise(text),
        )

    return F.coalesce(F.aggregate(found, c, expand), F.lit(""))


def classify_intent(c: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """First rule with a term inside the text; else general."""
    low = F.lower(c)
    out = None
    for name, terms in rules or fv.INTENT_RULES:
        hit = contains_any(low, terms)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def has_domain_term(c: Column, entities=None, acronyms=None, keywords=None) -> Column:
    """Whether the text names an entity, an abbreviation or a domain keyword."""
    low = F.lower(c)
    terms = [e.lower() for e in entities or fv.ENTITIES] + list(keywords or fv.DOMAIN_KEYWORDS)
    listed = F.array(*[F.lit(a) for a in acronyms or fv.ACRONYMS])
    tokens = F.transform(F.regexp_extract_all(c, F.lit("(?U)" + WORD), F.lit(0)), F.upper)
    return matches_any_word(low, terms) | F.arrays_overlap(tokens, listed)


def route(log: DataFrame, text: str = "text", note_id: str | None = None, assistant: str = "assistant",
          keywords: list[str] | None = None, lexicon: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """``log`` with intent, confidence and reason: guard first, then rules in order.

    Domain keywords are a short list (``keywords``), or a ``lexicon`` (entry) of any size that the log meets in a join; ``keys`` then tell the rows
    of the log apart.
    """
    guarded = guard(log, text)
    s, low = F.col("sanitized_text"), F.lower(F.col("sanitized_text"))
    medical = F.col("_domain")
    note = contains_any(low, fv.NOTE_TRIGGERS)
    if note_id is not None:
        note = note | F.col(note_id).isNotNull()
    greeting = F.lit(False)
    for p in fv.GREETING_PATTERNS:
        greeting = greeting | s.rlike("(?U)" + p.replace("{assistant}", assistant))
    off_topic = F.lit(False)
    for p in fv.OFF_TOPIC_PATTERNS:
        off_topic = off_topic | s.rlike("(?U)" + p)
    salutation = (F.size(words(s)) <= 4) & contains_any(low, fv.SALUTATIONS)

    def verdict(intent: str, confidence: float, reason: str) -> Column:
        return F.struct(
            F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), F.lit(fv.ROUTE_REASONS[reason]).alias("reason")
        )

    chosen = (
        F.when(~F.col("is_safe"), verdict("unsafe", 1.0, "guard"))
        .when(medical & note, verdict("note_query", 0.98, "note_query"))
        .when(~medical & greeting, verdict("greeting", 0.99, "greeting"))
        .when(~medical & off_topic, verdict("off_topic", 0.99, "off_topic"))
        .when(medical, verdict("medical", 0.95, "medical"))
        .when(salutation, verdict("greeting", 0.80, "salutation"))
        .otherwise(verdict("off_topic", 0.80, "unknown"))
    )
    if lexicon is None:
        flagged = guarded.withColumn("_domain", has_domain_term(s, keywords=keywords))
    else:
        hits = sized_side(written(with_phrase(guarded, keys, "sanitized_text", lexicon)).withColumn("_hit", F.lit(True)))
        known = has_domain_term(s, keywords=fv.ENTITIES)  # entities and abbreviations alone
        flagged = guarded.join(hits, keys, "left").withColumn("_domain", known | F.col("_hit").isNotNull())
    return flagged.withColumn("_v", chosen).select(*guarded.columns, "_v.*")


def route_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))

"""De-identification: detect, resolve, mask, audit and restore.

Detection and masking work inside the row that holds the text (:func:`deidentify`), so
the text is never shuffled. The long forms below it work on span tables, which are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import contains_any, let, match_offsets, strip, unnest, words

SPAN = "struct<start:int,end:int,category:string,original:string,detector:int>"
SPAN_FIELDS = ["start", "end", "category", "original", "detector"]
UNICODE = "(?U)"


def _name_ok(name: Column) -> Column:
    listed = F.array(*[F.lit(w) for w in fv.NOT_A_NAME])
    return ~F.arrays_overlap(words(name), listed)


def _signs(text: Column) -> dict[str, Column]:
    """What a text must hold for a detector to find anything: substrings and digits that cost less to look for than its pattern."""
    low = F.lower(text)
    runs = text.rlike(r"\p{Nd}{3}")
    return {
        "EMAIL": F.contains(text, F.lit("@")),
        "PHONE": runs,
        "SSN": runs,
        "AADHAAR": runs,
        # parts of the words in front of the value that no other letter folds to
        "MRN": contains_any(low, ["mrn", "cal record number", "med rec #"]),
        "DOB": contains_any(low, ["dob", "date of b", "rthdate"]),
        "ADDRESS": text.rlike(UNICODE + r"\d\s"),
        "PATIENT": contains_any(text, ["PATIENT", "Pt", "Patient", "ATTENDING", "Dr.", "Doctor", "Physician", "Mr.", "Mrs.", "Ms."]),
    }


def detected(text: Column) -> Column:
    """Array of candidate spans, by detector order and then text order."""
    arrays, signs = [], _signs(text)
    for number, (category, pattern, group) in enumerate(fv.PII_DETECTORS):
        found = match_offsets(text, UNICODE + pattern, group, signs.get(category))
        if category == "PATIENT":
            found = F.filter(found, lambda m: _name_ok(m["value"]))
        arrays.append(_labelled(found, category, number))
    return F.concat(*arrays)


def _labelled(found: Column, category: str, number: int) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(category).alias("category"),
            m["value"].alias("original"),
            F.lit(number).alias("detector"),
        ),
    )


def propagated(text: Column, spans: Column) -> Column:
    """Spans of every further whole-word sighting of a detected name."""
    named = F.filter(spans, lambda s: (s["category"] == "PATIENT") & (F.length(s["original"]) >= 3))
    names = F.array_distinct(F.transform(named, lambda s: s["original"]))

    def sightings(name: Column) -> Column:
        pattern = F.concat(F.lit(UNICODE + r"\b\Q"), name, F.lit(r"\E\b"))
        return _labelled(match_offsets(text, pattern), "PATIENT", len(fv.PII_DETECTORS))

    return F.flatten(F.transform(names, sightings))


def resolved(spans: Column) -> Column:
    """Greedy non-overlapping spans: earliest start, then longest, then detector order.

    A skipped span does not move the end, so this is a fold and not a running maximum.
    """
    keyed = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                (s["start"] - s["end"]).alias("minus_length"),
                s["detector"].alias("detector"),
                s["end"].alias("end"),
                s["category"].alias("category"),
                s["original"].alias("original"),
            ),
        )
    )

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"),
            s["original"].alias("original"), s["detector"].alias("detector"),
        )
        taken = F.struct(s["end"].alias("end"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(s["start"] >= acc["end"], taken).otherwise(acc)

    zero = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(keyed, zero, step, lambda acc: acc["out"])


CATEGORIES = [c for c, _, _ in fv.PII_DETECTORS]


def named(spans: Column) -> Column:
    """(tags, each): a map from original value to placeholder, numbered per category by first sighting, and the placeholder of every span.

    Equal values stand together once sorted; their first sightings, sorted by category and place, are numbered by how far they stand behind
    the first of their category. Sorts and passes, so a text's cost grows with its spans and not with their square.
    """
    listed = F.array(*[F.lit(c) for c in CATEGORIES])

    def firsts(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["original"] != F.get(s, j - 1)["original"]))

        def run(at: Column) -> Column:
            def first(st: Column, r: Column) -> Column:
                own = F.get(s, st)
                count = F.coalesce(F.get(at, r + 1), F.size(s)) - st
                return F.struct(own["category"].alias("category"), own["i"].alias("i"), own["original"].alias("original"), st.alias("st"), count.alias("n"))

            return F.sort_array(F.transform(at, first))

        return F.struct(s.alias("s"), let(starts, run).alias("f"))

    def numbered(p: Column) -> Column:
        heads = let(F.transform(p["f"], lambda f: f["category"]), lambda cats: F.transform(listed, lambda c: F.array_position(cats, c)))

        def tag(f: Column, j: Column, at: Column) -> Column:
            number = j + 2 - F.get(at, F.array_position(listed, f["category"]).cast("int") - 1)
            name = F.concat(F.lit("["), f["category"], F.lit("_"), number, F.lit("]"))
            return F.struct(f["i"].alias("i"), f["original"].alias("original"), name.alias("tag"), f["st"].alias("st"), f["n"].alias("n"))

        return F.struct(p["s"].alias("s"), let(heads, lambda at: F.transform(p["f"], lambda f, j: tag(f, j, at))).alias("t"))

    def told(p: Column) -> Column:
        entries = F.transform(F.array_sort(p["t"]), lambda t: F.struct(t["original"].alias("k"), t["tag"].alias("v")))
        runs = F.sort_array(F.transform(p["t"], lambda t: F.struct(t["st"].alias("st"), t["n"].alias("n"), t["tag"].alias("tag"))))
        by_value = F.flatten(F.transform(runs, lambda r: F.array_repeat(r["tag"], r["n"])))
        back = F.sort_array(F.zip_with(p["s"], by_value, lambda s, t: F.struct(s["i"].alias("i"), t.alias("tag"))))
        return F.struct(F.map_from_entries(entries).alias("tags"), F.transform(back, lambda b: b["tag"]).alias("each"))

    placed = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["original"].alias("original"), i.alias("i"), s["category"].alias("category"))))
    none = F.struct(F.create_map().cast("map<string,string>").alias("tags"), F.array().cast("array<string>").alias("each"))
    return F.when(F.size(spans) == 0, none).otherwise(let(let(let(placed, firsts), numbered), told))


def masked(text: Column, spans: Column, each: Column) -> Column:
    """``text`` with every span replaced by its placeholder in ``each``, assembled from the pieces between spans."""

    def assembled(p: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(p["spans"], i - 1)["end"])
            return F.concat(F.substr(p["text"], begin + 1, s["start"] - begin), F.get(p["each"], i))

        last = F.try_element_at(p["spans"], F.lit(-1))["end"]
        return F.concat(F.array_join(F.transform(p["spans"], piece), ""), F.substr(p["text"], last + 1, F.length(p["text"])))

    whole = F.struct(text.alias("text"), spans.alias("spans"), each.alias("each"))
    return F.when(F.size(spans) == 0, text).otherwise(let(whole, assembled))


def with_spans(docs: DataFrame, propagate: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a ``spans`` array of candidates."""
    base = docs.withColumn("spans", detected(F.col("text")))
    if propagate:
        base = base.withColumn("spans", F.concat("spans", propagated(F.col("text"), F.col("spans"))))
    return base


def deidentify(docs: DataFrame) -> DataFrame:
    """``docs`` with masked_text, the tag map, and counts; map-side only.

    A text that already holds a placeholder of ours cannot be restored, so it is marked
    ``quarantined``.
    """
    categories = "|".join(CATEGORIES)
    base = with_spans(docs).withColumn("spans", resolved(F.col("spans")))
    base = base.withColumn("named", named(F.col("spans"))).withColumn("tags", F.col("named.tags"))
    return base.select(
        *[c for c in docs.columns],
        "spans",
        "tags",
        masked(F.col("text"), F.col("spans"), F.col("named.each")).alias("masked_text"),
        F.size("spans").alias("spans_detected"),
        F.size("tags").alias("pii_entity_count"),
        F.col("text").rlike(rf"\[(?:{categories})_\d+\]").alias("quarantined"),
    )


def mapping_table(deidentified: DataFrame) -> DataFrame:
    """The restricted table (doc_id, placeholder, original, category)."""
    rows = deidentified.select("doc_id", unnest(F.map_entries("tags"), "original", "placeholder"))
    return rows.withColumn("category", F.regexp_extract("placeholder", r"^\[([A-Z]+)_", 1)).select(
        "doc_id", "placeholder", "original", "category"
    )


def spans_long(docs: DataFrame, propagate: bool = True) -> DataFrame:
    """One row per candidate span."""
    return with_spans(docs, propagate).select("doc_id", unnest(F.col("spans"), *SPAN_FIELDS))


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """:func:`resolved` over a span table."""
    row = F.struct("start", "end", "category", "original", "detector")
    docs = spans.groupBy("doc_id").agg(F.collect_list(row).alias("spans"))
    return docs.select("doc_id", unnest(resolved(F.col("spans")), *SPAN_FIELDS))


def assign_placeholders(spans: DataFrame) -> DataFrame:
    """Placeholders over a table of resolved spans: one row per document and value."""
    firsts = spans.groupBy("doc_id", "original").agg(
        F.min("start").alias("first_start"), F.min_by("category", "start").alias("category")
    )
    order = Window.partitionBy("doc_id", "category").orderBy("first_start")
    number = F.row_number().over(order)
    tag = F.concat(F.lit("["), F.col("category"), F.lit("_"), number, F.lit("]"))
    return firsts.select("doc_id", tag.alias("placeholder"), "original", "category", "first_start")


def pii_counts(deidentified: DataFrame) -> DataFrame:
    """Distinct values per document and category."""
    return mapping_table(deidentified).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n_values"))


def pii_rollup(deidentified: DataFrame) -> DataFrame:
    """Corpus roll-up of distinct values by source and category, with totals."""
    rows = deidentified.select("source", F.explode(F.map_values("tags")).alias("placeholder"))
    cat = rows.select("source", F.regexp_extract("placeholder", r"^\[([A-Z]+)_", 1).alias("category"))
    return cat.rollup("source", "category").agg(F.count(F.lit(1)).alias("n_values"))


def unmask_with(text: Column, tags: Column) -> Column:
    """Replace placeholders by originals; ``tags`` maps original to placeholder."""
    return F.aggregate(F.map_entries(tags), text, lambda acc, e: F.replace(acc, e["value"], e["key"]))


def unmask(masked_docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, masked_text) joined to its mapping and restored."""
    tags = mapping.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("original", "placeholder"))).alias("tags")
    )
    joined = masked_docs.join(tags, "doc_id", "left")
    restored = F.when(F.col("tags").isNull(), F.col("masked_text")).otherwise(unmask_with(F.col("masked_text"), F.col("tags")))
    return joined.withColumn("original_text", restored).drop("tags")


def leak_reasons(text: Column, originals: Column) -> Column:
    """Why ``text`` is unsafe: detector hits, and raw values of three characters or more."""
    patterns = {c: p for c, p, _ in fv.PII_DETECTORS}

    def reasons(p: Column) -> Column:
        hits = [F.when(p["text"].rlike(UNICODE + patterns[c]), F.lit(c)) for c in fv.LEAK_CATEGORIES]
        raw = F.exists(p["values"], lambda v: (F.length(strip(v)) >= 3) & F.contains(p["text"], v))
        return F.array_compact(F.array(*hits, F.when(raw, F.lit("RAW_VALUE"))))

    return let(F.struct(text.alias("text"), originals.alias("values")), reasons)


def _leaking(reasons: Column) -> Column:
    """Only rows with a reason; a generator, because a filter would be pushed below the
    masking projection and repeat its work."""
    return F.explode(F.filter(F.array(reasons), lambda r: F.size(r) > 0)).alias("reasons")


def leak_audit(deidentified: DataFrame, text: str = "masked_text") -> DataFrame:
    """Documents that leak, with reasons; empty when masking is sound."""
    return deidentified.select("doc_id", _leaking(leak_reasons(F.col(text), F.map_keys("tags"))))


def leak_audit_long(masked_docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """:func:`leak_audit` where text and mapping are separate tables."""
    originals = mapping.groupBy("doc_id").agg(F.collect_list("original").alias("originals"))
    joined = masked_docs.join(originals, "doc_id", "left")
    values = F.coalesce("originals", F.array().cast("array<string>"))
    return joined.select("doc_id", _leaking(leak_reasons(F.col("masked_text"), values)))


def assert_no_leak(audit: DataFrame) -> None:
    """Stop the job when the audit found anything."""
    bad = audit.limit(5).collect()
    if bad:
        raise ValueError(f"personal data left in masked text of documents {[r['doc_id'] for r in bad]}")


def note_diff(masked_docs: DataFrame, mapping: DataFrame, principals: DataFrame, owner: str = "source") -> DataFrame:
    """Masked beside original, for the owner and administrators only.

    The visibility join runs before the mapping is touched.
    """
    from quirefold.operators.governance import visible_rows

    seen = visible_rows(masked_docs, principals, owner)
    allowed = mapping.join(seen.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = allowed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pii_entity_count"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.map_from_entries(F.collect_list(F.struct("original", "placeholder"))).alias("tags"),
    )
    joined = seen.join(counts, "doc_id", "left")
    restored = F.when(F.col("tags").isNull(), F.col("masked_text")).otherwise(unmask_with(F.col("masked_text"), F.col("tags")))
    return joined.select(
        "principal", "doc_id", "masked_text", restored.alias("original_text"),
        F.coalesce("pii_entity_count", F.lit(0)).alias("pii_entity_count"), F.coalesce("categories", F.lit("")).alias("categories"),
    )

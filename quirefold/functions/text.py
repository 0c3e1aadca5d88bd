"""Column expressions over text: words, tokens, sentences. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold import fixed_values as fv

# Unicode white space, spelled out because the JVM's \s is ASCII only.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
BREAK = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Lambdas of higher-order functions do not share common subexpressions; a one-element
    array binds the value instead.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def spaced(c: Column) -> Column:
    """Every white-space character as a plain blank; native and cheaper than a pattern."""
    return F.translate(c, SPACES, " " * len(SPACES))


def words(c: Column) -> Column:
    """White-space separated words, no empties."""
    return F.filter(F.split(spaced(c), " "), lambda w: w != "")


def estimate_tokens(c: Column) -> Column:
    """1.3 tokens per word, cut to an integer, at least one."""
    return F.greatest(F.lit(1), F.floor(F.size(words(c)) * F.lit(fv.TOKENS_PER_WORD)).cast("int"))


def bm25_tokens(c: Column) -> Column:
    """Words of more than one character, lower case; ``-`` and ``/`` separate, other marks stay."""
    apart = F.translate(c, "-/" + SPACES, " " * (2 + len(SPACES)))
    return F.transform(F.filter(F.split(apart, " "), lambda w: F.length(w) > 1), F.lower)


def unnest(c: Column, *names: str) -> Column:
    """Rows of an array of structs, its elements computed once.

    A generator over a bare column makes the optimizer test the column's size below the
    projection that computes it, and extracting fields afterwards repeats that projection
    per field; a generator over an expression with named outputs does neither.
    """
    return F.inline(F.filter(c, lambda s: s.isNotNull() | F.lit(False))).alias(*names)


def split_sentences(c: Column, keep_empty: bool = False) -> Column:
    """Array of sentences.

    A sentence ends at ``. ``, ``? ``, ``! `` or two and more line feeds, unless its last
    word is a known abbreviation or one character and a dot. A blank piece behind an
    abbreviation keeps the sentence open; behind a finished sentence it is an empty
    sentence, which is dropped unless ``keep_empty``.
    """
    marked = F.regexp_replace(strip(c), r"(\. |\? |! |\n\n+)", "$1" + BREAK)
    pieces = F.split(marked, BREAK)

    def ends(piece: Column) -> Column:
        def decide(last: Column) -> Column:
            keeps_open = last.isin(fv.SENTENCE_ABBREVIATIONS) | ((F.length(last) == 2) & last.endswith("."))
            return F.when(last == "", F.lit(None).cast("boolean")).otherwise(~keeps_open)

        return let(F.lower(F.substring_index(F.rtrim(spaced(piece)), " ", -1)), decide)

    def rejoined(p: Column) -> Column:
        # places of the pieces that decide; a blank piece takes over what the last one before it decided
        known = F.filter(F.transform(p["flags"], lambda f, i: F.struct(i.alias("i"), f.alias("f"))), lambda r: r["f"].isNotNull())

        def spread(k: Column) -> Column:
            def run(r: Column, j: Column) -> Column:
                upto = F.coalesce(F.get(k, j + 1)["i"], F.size(p["flags"]))
                return F.array_repeat(r["f"], upto - r["i"])

            before = F.array_repeat(F.lit(True), F.coalesce(F.get(k, F.lit(0))["i"], F.size(p["flags"])))
            return F.concat(before, F.flatten(F.transform(k, run)))

        def closed(q: Column) -> Column:
            last = F.size(q["pieces"]) - 1
            pieces = F.zip_with(q["pieces"], q["ends"], lambda piece, end: F.concat(piece, F.when(end, F.lit(BREAK)).otherwise(F.lit(""))))
            return F.concat(F.array_join(F.slice(pieces, F.lit(1), last), ""), F.get(q["pieces"], last))

        return let(F.struct(p["pieces"].alias("pieces"), let(known, spread).alias("ends")), closed)

    def trimmed(raw: Column) -> Column:
        n = F.size(raw)
        kept = F.transform(raw, lambda s, i: F.when(i == n - 1, strip(s)).otherwise(rstrip(s)))
        if keep_empty:
            # the remainder behind the last break is never an empty sentence
            return F.filter(kept, lambda s, i: (s != "") | (i < n - 1))
        return F.filter(kept, lambda s: s != "")

    flagged = let(pieces, lambda p: F.struct(p.alias("pieces"), F.transform(p, ends).alias("flags")))
    return let(F.split(let(flagged, rejoined), BREAK), trimmed)


def claim_sentences(c: Column) -> Column:
    """Sentences cut behind ``.``, ``!`` or ``?``, stripped, no empties."""
    parts = F.split(c, f"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def contains_any(c: Column, terms: list[str]) -> Column:
    """Whether ``c`` holds any of ``terms`` as a substring."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | c.contains(term)
    return hit


def quoted(term: str) -> str:
    """``term`` as a literal inside a JVM pattern."""
    return r"\Q" + term + r"\E"


def matches_any_word(c: Column, terms: list[str]) -> Column:
    """Whether ``c`` holds any of ``terms`` as a whole word."""
    return c.rlike(r"(?U)\b(?:" + "|".join(quoted(t) for t in terms) + r")\b")


def match_offsets(text: Column, pattern: Column | str, group: int = 0, possible: Column | None = None) -> Column:
    """Array of (start, end, value) for every match, 0-based, in text order.

    The text between matches and the matches themselves tell the offsets, so no scan
    leaves the JVM; a text without a match costs one pass. With ``group`` 1 the group must close the match. Texts that are
    not ``possible`` skip the pattern.
    """
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    spans = "array<struct<start:int,end:int,value:string>>"

    def parts(whole: Column) -> Column:
        value = F.transform(whole, lambda w: F.call_function("regexp_extract", w, regex, F.lit(group))) if group else whole
        return F.struct(F.split(text, regex, -1).alias("between"), whole.alias("whole"), value.alias("value"))

    def fold(p: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            end = acc["at"] + F.length(F.get(p["between"], acc["i"])) + F.length(m)
            v = F.get(p["value"], acc["i"])
            span = F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"))
            return F.struct(
                end.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(span)).alias("out")
            )

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(spans).alias("out"))
        return F.aggregate(p["whole"], zero, step, lambda acc: acc["out"])

    none = F.array().cast(spans)
    found = let(F.regexp_extract_all(text, regex, F.lit(0)), lambda w: F.when(F.size(w) > 0, let(parts(w), fold)).otherwise(none))
    return found if possible is None else F.when(possible, found).otherwise(none)

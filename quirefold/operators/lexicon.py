"""Phrases of a lexicon of any size in texts, found by a hash join instead of a pattern.

A text's words with what stands between them are cut into runs of as many words as the lexicon's phrases have. Two 64-bit hashes of a run, lower
case, meet those of the phrases; only ids, places and hashes are shuffled. Phrases begin and end with a word character, as a pattern
with word edges would need; others are never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import let
from quirefold.session import BROADCAST_ROWS, written

MAX_WORDS = 12
PIECES = r"(?U)\w+|\W+"
SLOT_BITS = 26  # a map of 8 MB
ROW_WORDS = 512


def _hashes(phrase: Column) -> list[Column]:
    return [F.xxhash64(phrase).alias("h1"), F.xxhash64(phrase, F.lit(1)).alias("h2")]


def phrases(lexicon: DataFrame, name: str = "entry") -> DataFrame:
    """(entry in lower case, n_words, h1, h2) of the distinct phrases."""
    entries = lexicon.select(F.lower(name).alias("entry")).where(F.col("entry").rlike(r"(?U)^\w(.*\w)?$")).distinct()
    return entries.select("entry", F.regexp_count("entry", F.lit(r"(?U)\w+")).alias("n_words"), *_hashes(F.col("entry")))


def _slot_map(known: DataFrame) -> DataFrame:
    """(part, words): a bit map of 2^SLOT_BITS slots with a bit for each phrase, in rows of ROW_WORDS words of 64 bits.

    Its size does not grow with the lexicon. It says of a run 'perhaps' or 'no'; the join on the whole hashes decides.
    """
    slot = F.shiftrightunsigned("h1", 64 - SLOT_BITS)
    marks = known.select(slot.alias("slot")).select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    words = marks.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    own = F.map_from_entries(F.collect_list(F.struct(F.expr(f"word % {ROW_WORDS}").alias("at"), "bits")))
    rows = words.groupBy(F.expr(f"word div {ROW_WORDS}").alias("part")).agg(own.alias("own"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(ROW_WORDS - 1).cast("long"))
    return rows.select("part", F.transform(every, lambda i: F.coalesce(F.try_element_at("own", i), F.lit(0).cast("long"))).alias("words"))


def _perhaps(runs: DataFrame, known: DataFrame) -> DataFrame:
    """The runs whose slot a phrase has: what can match and a few others, so that a text's runs do not all go into a shuffle."""
    slot = F.shiftrightunsigned("h1", 64 - SLOT_BITS)
    placed = runs.withColumn("slot", slot).withColumn("part", F.expr(f"slot div {64 * ROW_WORDS}"))
    met = placed.join(F.broadcast(written(_slot_map(known))), "part")
    return met.where(F.expr(f"(shiftrightunsigned(get(words, cast(slot div 64 % {ROW_WORDS} as int)), cast(slot % 64 as int)) & 1L) = 1")).select(*runs.columns)


def _lengths(known: DataFrame) -> list[int]:
    found = [r.n_words for r in known.select("n_words").distinct().limit(MAX_WORDS + 1).collect()]
    if len(found) > MAX_WORDS or max(found, default=0) > MAX_WORDS:
        raise ValueError(f"phrases of more than {MAX_WORDS} words are not looked for")
    return sorted(found)


def _runs(text: Column, lengths: list[int]) -> Column:
    """(at, n_words, run) of all runs of the given numbers of words, in lower case; ``at`` is the piece where a run starts."""

    def cut(pieces: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.get(pieces, i).rlike(r"(?U)^\w"))

        def of(n: int) -> Column:
            whole = F.filter(firsts, lambda i: i + 2 * n - 1 <= F.size(pieces))
            return F.transform(whole, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n_words"), F.lower(F.array_join(F.slice(pieces, i + 1, F.lit(2 * n - 1)), "")).alias("run")))

        return F.concat(*[of(n) for n in lengths])

    none = F.array().cast("array<struct<at:int,n_words:int,run:string>>")
    return let(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.when(F.size(p) > 0, cut(p)).otherwise(none))


def mentions(texts: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(``keys``, at, n_words, entry): every phrase at every place, overlapping ones too.

    ``keys`` tell the texts apart; ``at`` counts words and what stands between them from 0. A lexicon of more than ``BROADCAST_ROWS`` phrases meets the
    runs in a shuffle, and only those that a bit map of its hashes lets through.
    """
    known = written(phrases(lexicon))
    lengths = _lengths(known)
    if not lengths:
        return texts.select(*keys, F.lit(0).alias("at"), F.lit(0).alias("n_words"), F.lit("").alias("entry")).limit(0)
    runs = texts.select(*keys, F.inline(_runs(F.col(text), lengths)))
    slim = runs.select(*keys, "at", "n_words", *_hashes(F.col("run")))
    if known.count() <= BROADCAST_ROWS:
        side = F.broadcast(known)
    else:
        # by the bytes of the texts' files the planner would broadcast their runs
        slim, side = _perhaps(slim, known), known.hint("merge")
    return slim.join(side, ["n_words", "h1", "h2"]).select(*keys, "at", "n_words", "entry")


def longest(found: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, hits): of the mentions of a text the first ones from the left, the longest at each place, none inside another."""
    row = F.struct("at", (-F.col("n_words")).alias("less"), "n_words", "entry")
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_set(row)).alias("m"))

    def step(acc: Column, m: Column) -> Column:
        hit = F.struct(m["at"].alias("at"), m["n_words"].alias("n_words"), m["entry"].alias("entry"))
        taken = F.struct((m["at"] + 2 * m["n_words"] - 1).alias("end"), F.concat(acc["out"], F.array(hit)).alias("out"))
        return F.when(m["at"] >= acc["end"], taken).otherwise(acc)

    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n_words:int,entry:string>>").alias("out"))
    return per.select(*keys, F.aggregate("m", zero, step, lambda acc: acc["out"]).alias("hits"))


def with_phrase(texts: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """The distinct ``keys`` of the texts that hold any phrase."""
    return mentions(texts, keys, text, lexicon).select(*keys).distinct()


def placed(text: Column, hits: Column) -> Column:
    """Array of (start, end, value) of a text's ``hits``, as match_offsets gives them; meant for sentences."""

    def spots(p: Column) -> Column:
        def spot(h: Column) -> Column:
            start = F.length(F.array_join(F.slice(p["pieces"], F.lit(1), h["at"]), ""))
            value = F.array_join(F.slice(p["pieces"], h["at"] + 1, 2 * h["n_words"] - 1), "")
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        return F.transform(p["hits"], spot)

    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return let(F.struct(pieces.alias("pieces"), hits.alias("hits")), spots)

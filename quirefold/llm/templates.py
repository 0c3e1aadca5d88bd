"""Benchmark decontamination by templates: finds benchmark items in texts, also with other numbers, names or units.

A text is read as tokens: runs of letters, digits and bytes above 127 (dots and commas inside numbers stay). Each token is a word or a slot:
``number`` (starts with a digit, or a number word), ``unit`` (a known measure right after a number) or ``name``. The template replaces slots by their type.

Some tokens can be read in two ways, so windows of ``WINDOW`` tokens are hashed in several readings. A capitalised word that opens a sentence of an item is a
word or a name (all choices), a number word is a word or a number (all of a window alike). In a text every capitalised word may stand for a name, and any word of a
sentence without one (lower-cased and all-capital copies); which places are tried is told by the items. A fixed-size bit map of the items' window hashes
keeps the texts' other windows out of the shuffle, and a hash join with the items' windows decides. Readings with fewer
than ``SOLID`` words are left out, as templates of slots alone fit anything.

Items of fewer than ``WINDOW`` tokens have one window of their own length. Items that have no usable reading at all (few words, or slots everywhere) are
looked for verbatim: their windows' tokens are compared as they stand, numbers and names included.

A pair of text and item is a leak when at least ``MATCHED`` windows of the item (all, if it has fewer) are found with consistent slots:
within one item a slot value always maps to the same value of the text, and different values to different ones. This is judged for each place of the
text on its own (windows with one offset between text and item, and those with offsets up to ``NEAR`` apart, for words put in or left out) and for the whole text; the best counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import arrays as A
from quirefold.session import release, written

WINDOW = 8
SOLID = 5
MATCHED = 6
NEAR = 4
# Measures that count as units after a number.
UNITS = (
    "mm cm m km in ft yd mi miles mile meters metres meter metre kilometers kilometres feet foot inches inch mg g kg lb lbs oz grams gram kilograms pounds ounces "
    "ml l liters litres liter litre gallons gallon s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year "
    "usd eur dollars dollar euros euro cents cent percent degrees degree mph kmh"
).split()
# Spelled-out numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
FOUND = "id long, hash long, at long, slots string"
VERBATIM = 1 << 2 * WINDOW
WINDOWS = f"{FOUND}, win long, free boolean, shape int"

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 58, 63]] = True
NUMBER, UNIT, NAME = (A.mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))


PLACE = A.mix(np.arange(101, 101 + WINDOW, dtype=np.uint64)) | np.uint64(1)


def _word_hashes(words: list[str]) -> np.ndarray:
    data, starts = A.text_bytes(pa.array(words))
    return np.sort(A.spans_hash(A.prefix_hash(data, A.LETTER_FOLDED), starts[:-1], starts[1:]))


UNIT_HASHES, NUMBER_HASHES = _word_hashes(UNITS), _word_hashes(NUMBER_WORDS)


def _among(sorted_hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    return sorted_hashes[np.searchsorted(sorted_hashes, word).clip(max=len(sorted_hashes) - 1)] == word


class Tokens:
    """The tokens of some texts; a dot or comma between digits belongs to the number.

    ``readings`` holds (template hashes, is slot) with number words as words and as numbers, names as words in both; ``inside`` and ``opening`` mark
    capitalised words by their place in the sentence, ``nameable`` all that may stand for a name.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        solid = TOKEN[data]
        if n > 2:
            mid = ((data[1:-1] == 44) | (data[1:-1] == 46)) & DIGIT[data[:-2]] & DIGIT[data[2:]]
            solid[1:-1] |= mid
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        before, after = np.concatenate(([False], solid[:-1])), np.concatenate((solid[1:], [False]))
        if not n:
            before = after = solid
        self.data = data
        self.begin = begin = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.at = at = np.searchsorted(begin, starts)
        self.text = np.repeat(np.arange(len(starts) - 1), np.diff(at))
        if not len(begin):
            return
        self.word = word = A.spans_hash(A.prefix_hash(data, A.LETTER_FOLDED), begin, end)
        heads = at[:-1][np.diff(at) > 0]
        number = DIGIT[data[begin]]
        self.spelled = _among(NUMBER_HASHES, word)
        unit = _among(UNIT_HASHES, word)
        unit[heads] = False
        self.readings = []
        for counts in (number, number | self.spelled):
            measure = unit & np.concatenate(([False], counts[:-1])) & ~counts
            template = word.copy()
            template[counts], template[measure] = NUMBER, UNIT
            self.readings.append((template, counts | measure))
        stops, lows = (np.concatenate(([0], np.cumsum(t[data]))) for t in (STOP, LOWER))
        opens = stops[begin] != stops[np.concatenate(([0], end[:-1]))]
        opens[heads] = True
        capital = UPPER[data[begin]] & (lows[end] > lows[begin])
        self.inside, self.opening = capital & ~opens, capital & opens
        sentence = np.cumsum(opens)
        self.nameable = (capital | (np.bincount(sentence, capital)[sentence] == 0)) & ~number

    def same(self, size: int) -> np.ndarray:
        """Where ``size`` tokens of one text start."""
        m = len(self.begin) - size + 1
        return self.text[:m] == self.text[size - 1 :] if m > 0 else np.zeros(0, bool)

    def slots(self, i: int, places) -> str:
        """The values at these places of a window, lower case."""
        return "\x1f".join(f"{k}={self.data[self.begin[i + k] : self.end[i + k]].tobytes().decode('utf-8', 'replace').lower()}" for k in places)


def _hashes(template: np.ndarray, first: np.ndarray, size: int, names, kind: int = 0) -> np.ndarray:
    """Of the windows of ``size`` tokens from ``first``, with names at these places."""
    out = np.full(len(first), size + kind, np.uint64)
    for k in range(size):
        out += (NAME if k in names else template[first + k]) * PLACE[k : k + 1]
    return A.mix(out)


def _places(mask: int) -> list[int]:
    return [k for k in range(WINDOW) if mask >> k & 1]


def item_windows(data: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """(item, hash, position, slots, window, free, shape) of all readings of all windows.

    ``window`` is the hash of the reading with the fewest slots and tells windows apart, ``free`` that the one with the most slots is usable too; ``shape`` is
    the places of names, with the length of the window above and ``VERBATIM`` for tokens as they stand.
    """
    t = Tokens(data, starts)
    out = []
    for a, b in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True):
        size = min(WINDOW, b - a)
        if not size:
            continue
        found = [row for i in range(a, b - size + 1) for row in _readings(t, i, size)]
        if not found:
            first = np.arange(a, b - size + 1)
            hashes = _hashes(t.word, first, size, (), VERBATIM).view(np.int64).tolist()
            found = [(int(t.text[a]), h, 0, "", h, True, VERBATIM | size << WINDOW) for h in dict.fromkeys(hashes)]
        out += found
    return out


def _readings(t: Tokens, i: int, size: int) -> list[tuple]:
    at, own = np.array([i]), range(i, i + size)
    found, win, free = [], None, False
    for template, slot in t.readings if t.spelled[i : i + size].any() else t.readings[:1]:
        fixed = [k - i for k in own if slot[k]]
        sure = sum(1 << k - i for k in own if t.inside[k] and not slot[k])
        maybe = sum(1 << k - i for k in own if t.opening[k] and not slot[k])
        some = maybe
        while True:  # all subsets, the full one first
            names = _places(sure | some)
            usable = size - len(fixed) - len(names) >= SOLID
            if some == maybe:
                free = usable
            if usable:
                h = int(_hashes(template, at, size, names).view(np.int64)[0])
                win = h if win is None or (some == 0 and template is t.readings[0][0]) else win
                found.append((h, t.slots(i, sorted(fixed + names)), sure | some | size << WINDOW))
            if not some:
                break
            some = (some - 1) & maybe
    return [(int(t.text[i]), h, i - int(t.at[t.text[i]]), slots, win, free, shape) for h, slots, shape in found]


def windows(data: np.ndarray, starts: np.ndarray, wanted: A.IdFilter, shapes: list[int]) -> list[tuple]:
    """(text, hash, position, slots) of the windows that may be wanted; slots lists their values by place."""
    t = Tokens(data, starts)
    out = []
    for size in sorted({(s & VERBATIM - 1) >> WINDOW for s in shapes}):
        same = t.same(size)
        m = len(same)
        if not same.any():
            continue
        if VERBATIM | size << WINDOW in shapes:
            first = np.flatnonzero(same)
            hashes = _hashes(t.word, first, size, (), VERBATIM)
            hit = np.flatnonzero(wanted.maybe(hashes >> np.uint64(64 - A.IdFilter.BITS)))
            out += [(x, h, 0, "") for x, h in sorted(set(zip(t.text[first[hit]].tolist(), hashes[hit].view(np.int64).tolist(), strict=True)))]
        total = lambda marks: np.concatenate(([0], np.cumsum(marks)))[size:] - np.concatenate(([0], np.cumsum(marks)))[:m]  # noqa: B023, E731
        for r, (template, slot) in enumerate(t.readings):
            good = same & (total(t.spelled) > 0) if r else same
            words = size - total(slot)
            free = t.nameable & ~slot
            plain = np.full(m, size, np.uint64)
            for k in range(size):
                plain += template[k : m + k] * PLACE[k]
            fit = {}
            for shape in shapes:
                if shape >> WINDOW != size:
                    continue
                names = _places(shape)
                if len(names) not in fit:
                    fit[len(names)] = good & (words >= SOLID + len(names))
                ok = fit[len(names)]
                for k in names:
                    ok = ok & free[k : m + k]
                first = np.flatnonzero(ok)
                hashes = plain[first]
                for k in names:
                    hashes += (NAME - template[first + k]) * PLACE[k]
                hashes = A.mix(hashes)
                hit = np.flatnonzero(wanted.maybe(hashes >> np.uint64(64 - A.IdFilter.BITS)))
                for i, h in zip(first[hit].tolist(), hashes[hit].view(np.int64).tolist(), strict=True):
                    places = sorted([*names, *(k for k in range(size) if slot[i + k])])
                    out.append((int(t.text[i]), h, i - int(t.at[t.text[i]]), t.slots(i, places)))
    return out


def _emit(read, schema: str):
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[k] for k in kinds]

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            data, starts = A.text_bytes(batch.column("text"))
            for i, j in A.chunks(starts, A.CHUNK // 4):  # all readings of a chunk are held at once
                found = read(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                cols = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i + t] for t in cols[0]], types[0]), *(pa.array(c, t) for c, t in zip(cols[1:], types[1:], strict=True))], names=names)

    return run


def _window_filter(items: DataFrame) -> A.IdFilter:
    """The items' window hashes as a bit map of fixed size."""
    slot = items.select(F.expr(f"shiftrightunsigned(hash, {64 - A.IdFilter.BITS})").alias("s"))
    bits = slot.select(F.expr("s div 64").alias("word"), F.expr("cast(s % 64 as int)").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    words = np.zeros((1 << A.IdFilter.BITS) // 64, np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return A.IdFilter(words.view(np.uint64))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched): every leaked item of every text.

    n_windows counts the item's different windows, n_matched those found with consistent slots at the best place of the text. Items without a usable reading are
    found verbatim; null or empty texts and items match nothing; null ids are left out; rows with the same id and text count once, and so do rows of an
    item. Other columns are not read.
    """
    source = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null")
    items = written(source.mapInArrow(A.tidy(_emit(item_windows, WINDOWS)), WINDOWS))
    wanted, shapes = _window_filter(items), sorted(r.shape for r in items.select("shape").distinct().collect())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    read = lambda data, starts: windows(data, starts, wanted, shapes)
    found = texts.mapInArrow(A.tidy(_emit(read, FOUND)), FOUND).select(F.col("id").alias("doc_id"), "hash", F.col("at").alias("there"), F.col("slots").alias("theirs")).distinct()
    sizes = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("win").alias("n_windows"), F.countDistinct(F.when(F.col("free"), F.col("win"))).alias("n_free"))
    known = items.groupBy(F.col("id").alias("item_id"), "hash", F.col("slots").alias("ours"), "win", "free").agg(F.min("at").alias("here"))
    place = F.col("there") - F.col("here")
    cell = F.floor(place / NEAR)
    # the runs that a hit belongs to: the whole text, its offset, two cells of offsets that overlap by half
    runs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("v")) for k, v in enumerate((F.lit(0), place, cell, cell - 1))])
    hits = written(found.join(known, "hash").select("doc_id", "item_id", "hash", "ours", "theirs", "win", "free", F.explode(runs).alias("run")).distinct())
    release(docs.sparkSession)
    # the pairs (value of the item, value of the text) of all slots; a clash takes the windows that use it out
    pair = F.transform(
        F.split("ours", "\x1f"), lambda v, i: F.struct(F.substring_index(v, "=", -1).alias("o"), F.substring_index(F.get(F.split("theirs", "\x1f"), i), "=", -1).alias("t"))
    )
    group = ["doc_id", "item_id", "run"]
    row = [*group, "hash", "ours", "theirs"]
    pairs = hits.where("ours <> ''").select(*row, "win", F.explode(pair).alias("p")).select(*row, "win", "p.*")
    used = pairs.groupBy(*group, "o", "t").agg(F.countDistinct("win").alias("n"))
    # of clashing maps the one that most windows support stands (then the smaller value)
    rank = F.struct(-F.col("n"), "o", "t")
    best_o = used.groupBy(*group, "o").agg(F.min(rank).alias("b")).select(*group, "b.o", "b.t")
    best_t = used.groupBy(*group, "t").agg(F.min(rank).alias("b")).select(*group, "b.o", "b.t")
    keys = [*group, "o", "t"]
    clash = used.select(*keys).exceptAll(best_o.intersect(best_t))
    bad = pairs.join(clash, keys, "left_semi").select(*row).distinct()
    fine = hits.join(bad, row, "left_anti")
    matched = fine.groupBy(*group).agg(F.countDistinct("win").alias("n_matched"), F.countDistinct(F.when(F.col("free"), F.col("win"))).alias("m_free"))
    # windows that names make too thin cannot be found renamed; where the others are at least half, they decide too
    renamed = (F.col("n_free") * 2 >= F.col("n_windows")) & (F.col("m_free") >= F.least(F.lit(MATCHED), "n_free"))
    enough = matched.join(sizes, "item_id").where((F.col("n_matched") >= F.least(F.lit(MATCHED), "n_windows")) | renamed)
    return enough.groupBy("doc_id", "item_id").agg(F.first("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns; rows without an id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)

"""SpotSigs fingerprints, in DataFrame functions only.

A text is its words (runs of letters and digits, lower case). Every common word is an anchor; the first ``chain`` content words among the
``reach`` words behind it make one signature with it. A fingerprint is the set of signature hashes; a text without any takes its whole word sequence as its
one signature, a text without words has none. Fingerprints fall into partitions by set length: with similarity t or more, lengths differ by a
factor of 1/t at most, so only neighbouring partitions are compared, and sets whose lengths rule the similarity out are not intersected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import let
from quirefold.llm.arrays import range_of
from quirefold.session import written

# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "the of and to in is was for it with as on be by at this are from or an a that he which not but have has had they you we his her their its "
    "der die das und von zu den mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem ueber einen so zum "
    "le la les un une et du que qui dans pour par sur est au pas plus avec sont ce il elle ne se des en "
    "el los las y o una por con para su al lo como mas pero sus del que no si"
).split()
BUCKET_ROWS = 2000
MAX_BUCKETS = 4096


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column, chain: int = 2, reach: int = 8, anchors=tuple(dict.fromkeys(ANCHORS))) -> Column:
    """The sorted set of signature hashes."""
    common = lambda w: w.isin(*anchors)

    def of(ws: Column) -> Column:
        def one(w, i):
            content = F.slice(F.filter(F.slice(ws, i + 2, reach), lambda x: ~common(x)), 1, chain)
            return F.when(common(w), let(content, lambda c: F.when(F.size(c) == chain, F.xxhash64(w, c))))

        found = F.array_sort(F.array_distinct(F.filter(F.transform(ws, one), lambda s: s.isNotNull())))
        whole = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.lit("whole"), ws))).otherwise(F.array().cast("array<long>"))
        return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))

    return let(words(text), of)


def length_partition(n: Column, at_least: float) -> Column:
    """Partition of a set length: neighbours hold all lengths within a factor of 1 / at_least."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / -math.log(at_least) + 1e-9)).otherwise(-1).cast("int")


def fingerprint(sigs: Column, at_least: float = 0.8) -> Column:
    """Length partition, set length and a digest of the set."""
    return F.concat_ws(":", length_partition(F.size(sigs), at_least), F.size(sigs), F.sha2(F.concat_ws(",", F.transform(sigs, lambda s: F.hex(s))), 256))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity; 0 where the lengths alone keep it below ``at_least``; two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when(small < at_least * large, 0.0).when(small == 0, 0.0).otherwise(let(same, lambda s: s / (F.size(a) + F.size(b) - s)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the row with the next smaller id; the first row's behind the last.

    Rows are dealt to ranges of ids of about ``BUCKET_ROWS`` rows; the row that opens a range is also sent to the range before it. Texts are shuffled once. Rows
    of one id follow by a hash of their text; null ids come last.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    n = min(max(1, -(-docs.count() // BUCKET_ROWS)), MAX_BUCKETS)
    cuts = sorted(set(rows.approxQuantile("at", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    rows = rows.withColumn("bucket", range_of("at", cuts))
    heads = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.max("at").alias("at")).collect())  # one row per range
    moves = [(at, heads[(k + 1) % len(heads)][0]) for k, (_, at) in enumerate(heads)]
    guests = rows.drop("bucket").join(F.broadcast(docs.sparkSession.createDataFrame(moves, "at long, bucket int")), "at").select("doc_id", "text", "at", "bucket")
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("at"), F.desc(F.xxhash64("text")))
    return both.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The last third of the text replaced by as much of the beginning of another."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def compare_with_next(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to the edited form and the next text."""
    out = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    sets = out.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array(*[signatures(F.col(c)) for c in ("text", "edited", "next_text")]).alias("s"),
    )
    own, changed, following = (F.get("s", k) for k in range(3))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own, at_least).alias("fingerprint"), fingerprint(changed, at_least).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, following).alias("near_next"),
    )


def similar(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of all pairs of different fingerprints with that similarity, told by the smallest id that has each.

    Copies are one class each. Sets are indexed under the signatures of their prefix (length - ceil(at_least * length) + 1, by hash), within their
    length partition and the one above. Texts without words and null ids are left out.
    """
    sets = docs.where("doc_id is not null").select("doc_id", signatures(F.col("text")).alias("s")).where(F.size("s") > 0)
    classes = written(sets.groupBy("s").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("s")).withColumn("part", length_partition(F.size("s"), at_least)))
    prefix = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1).cast("int"))
    index = classes.select("doc_id", "n", "part", F.explode(prefix).alias("sig"))
    twin = index.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.explode(F.array("part", F.col("part") - 1, F.col("part") + 1)).alias("part"), "sig")
    pairs = index.join(twin, ["part", "sig"]).where(F.col("doc_id") < F.col("b")).where((F.least("n", "m") >= F.greatest("n", "m") * at_least - 1e-9)).select(F.col("doc_id").alias("a"), "b").distinct()
    left, right = (classes.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    near = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), at_least).alias("likeness"))
    return near.where(F.col("likeness") >= at_least)

"""Licence lookup by canonical digest, in DataFrame functions only.

A text becomes canonical by dropping copyright lines, lower-casing, turning every run of other characters than letters and digits into one
space and replacing equivalent spellings. The SHA-256 of the whole canonical text is joined to the digests of the known
licences. Units are the whole text and each of its lines; no part of a unit matches. Only digests are compared, nothing
is shuffled but the matches: the known table is broadcast when its digests are few enough to prove small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import unnest
from quirefold.llm.license_texts import LICENSES, SPELLINGS

COPYRIGHT = r"(?im)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """The canonical form; null for null, empty if nothing is left. A text of copyright lines alone is empty."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, "")), OTHER, " ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def _units(text: Column) -> Column:
    """(whole, c): the canonical forms of a text and of each of its lines, empty ones left out."""
    each = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), canonical(text).alias("c"))),
        F.transform(F.filter(F.split(text, "\n"), lambda line: line != ""), lambda line: F.struct(F.lit(False).alias("whole"), canonical(line).alias("c"))),
    )
    return F.filter(each, lambda u: u["c"] != "")


def known(spark: SparkSession, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """(license_id, digest) of the given texts; texts with one digest are told as the first identifier."""
    rows = spark.createDataFrame(list(licenses.items()), "license_id string, text string")
    return rows.select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''").groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """(doc_id, license_id, whole, n_lines): licences that a text is (whole) or that stand on n_lines of its lines.

    One row per document and licence found; documents without one have no row. Null, empty and blank texts match nothing; rows with one
    id add up; rows without an id are told under null. Other columns are not read.
    """
    licenses = licenses.select("digest", "license_id")
    if licenses.count() <= BROADCAST_ROWS:  # 64 hex digits and a name each: some 20 MB at most
        licenses = F.broadcast(licenses)
    # one array of units per row: a union would read the texts twice, and a condition on a computed column would compute it again on its way down
    units = docs.select("doc_id", unnest(F.transform(_units(F.col("text")), lambda u: F.struct(u["whole"].alias("whole"), F.sha2(u["c"], 256).alias("digest"))), "whole", "digest"))
    return units.join(licenses, "digest").groupBy("doc_id", "license_id").agg(F.max("whole").alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("n_lines"))

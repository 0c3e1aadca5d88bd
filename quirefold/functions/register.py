"""The library's functions under SQL names."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quirefold import fixed_values as fv
from quirefold.functions.vectors import hash_embed

# SQL bodies stay in the JVM like the column forms they mirror.
SQL_FUNCTIONS = {
    "estimate_tokens(t STRING) RETURNS INT": (
        f"greatest(1, CAST(floor({fv.TOKENS_PER_WORD}D * size(filter(split(t, '\\\\s+'), w -> w <> ''))) AS INT))"
    ),
    "bm25_tokens(t STRING) RETURNS ARRAY<STRING>": (
        "transform(filter(split(translate(t, '-/', '  '), '\\\\s+'), w -> length(w) > 1), w -> lower(w))"
    ),
    "cosine01(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "round(greatest(0D, least(1D, (aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) + 1) / 2)), 4)"
    ),
}


@udtf(returnType="start int, end int, category string, original string")
class PiiSpans:
    """Candidate spans of one text as a table function."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for category, pattern, group in fv.PII_DETECTORS:
            for m in re.finditer(pattern, text or ""):
                value = m.group(group)
                if category != "PATIENT" or not set(value.split()) & set(fv.NOT_A_NAME):
                    yield m.start(group), m.end(group), category, value


def register_udfs(spark: SparkSession) -> None:
    """Make estimate_tokens, bm25_tokens, cosine01, hash_embed and pii_spans callable from SQL."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("hash_embed", hash_embed)
    spark.udtf.register("pii_spans", PiiSpans)

"""The corpus pipeline: toxic texts go, one text of each group of near copies stays, repeated passages go, leaked benchmark texts go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import arrays, jaccard_join, merge_dropout, suffix_dedup, templates, toxicity
from quirefold.session import written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrays.short_batches(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 and more; the smallest id of a group stays."""
    return jaccard_join.keep_first(docs, 5, 4, 5)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated strings of 200 bytes; what a cut leaves of a character goes too."""
    return suffix_dedup.without_repeats(docs, 200)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = merge_dropout.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), 0.1, 1)
    return out.select("doc_id", "pieces", "n_tokens", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "lossless")


STAGES = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_copies_out),
    ("suffix-array dedup", repeats_out),
    ("benchmark decontamination", leaks_out),
    ("SentencePiece encoding and decoding", encoded),
]

# A recurrent network and a seeded segmentation are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

"""Reading documents, notes, golden questions and manifests, every schema declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import small_side

GOLDEN_SCHEMA = (
    "id string, question string, expected_answer string, expected_document string, expected_page int, "
    "expected_drugs array<struct<drug:string,dosage:string,frequency:string>>, category string, difficulty string"
)


def load_corpus(df: DataFrame, active: str = "is_active", newest: str = "created_at", key: str = "doc_id") -> DataFrame:
    """Active documents, newest first; the filter reaches the scan."""
    return df.filter(F.col(active)).orderBy(F.desc(newest), F.desc(key))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def load_notes(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file; bytes that are not UTF-8 become the replacement character."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("title"), F.make_valid_utf8(F.col("value")).alias("text"))


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of golden questions."""
    return spark.read.schema(GOLDEN_SCHEMA).json(path, multiLine=True)


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` plus the rows of ``incoming`` whose key is new; the first row by ``order`` wins a key.

    ``min_by`` keeps one row per key before the shuffle, so repeated keys cost little.
    """
    row = F.struct(*incoming.columns)
    first = incoming.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, order).alias("r")).select("r.*")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti"))


def unregistered(manifest: DataFrame, registered: DataFrame, key: str = "title") -> DataFrame:
    """Manifest rows not yet registered, one per title."""
    return manifest.dropDuplicates([key]).join(registered.select(key), key, "left_anti")


def denormalize(df: DataFrame, dim: DataFrame, key: str, name: str, alias: str) -> DataFrame:
    """``df`` with a name looked up in a dimension; broadcast while the dimension is small."""
    looked = dim.select(F.col(key), F.col(name).alias(alias))
    return df.join(small_side(looked), key, "left")

"""A corpus store on disk: the narrow table and its term counts, in versions that appear whole.

``chunks/version=N/doc_bucket=B`` holds the buckets that version N changed, ``counts/version=N`` its term counts, and ``versions/version=N`` one
row for each bucket with the version that holds it. The last is written last, and readers start from it: a version whose
writer died is not seen, and the next writer takes its number and overwrites what it left. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.lexical import changed_counts, counted
from quirefold.operators.store import narrowed
from quirefold.session import small_side, written
from quirefold.sources.sinks import bucket_of


TASK_ROWS = 10_000


@dataclass
class CorpusStore:
    spark: SparkSession
    path: str
    buckets: int = 256

    def versions(self) -> list[int]:
        try:
            found = self.spark.read.parquet(f"{self.path}/versions").select("version").distinct().collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(int(r.version) for r in found)

    def _version(self, version: int | None) -> int:
        have = self.versions()
        if not have:
            raise ValueError(f"no finished version in {self.path}")
        if version is not None and version not in have:
            raise ValueError(f"no version {version}")
        return have[-1] if version is None else version

    def _held(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions").where(F.col("version") == version).select("doc_bucket", "at")

    def _chunks(self, version: int) -> DataFrame:
        every = self.spark.read.parquet(f"{self.path}/chunks")
        # as many rows as there are buckets; files of other versions are pruned by partition
        held = self._held(version).withColumnRenamed("at", "version")
        return every.join(F.broadcast(held), ["doc_bucket", "version"]).drop("version")

    def chunks(self, version: int | None = None) -> DataFrame:
        """chunk_id, doc_id, length, terms, embedding of a version, the last by default."""
        return self._chunks(self._version(version)).drop("doc_bucket")

    def counts(self, version: int | None = None) -> DataFrame:
        """The version's (term, n), see :func:`quirefold.operators.lexical.corpus_counts`."""
        return self.spark.read.parquet(f"{self.path}/counts/version={self._version(version)}")

    def _publish(self, version: int, chunks: DataFrame, counts: DataFrame | None, held: DataFrame, rows: int) -> None:
        """``counts`` are those of the version, taken from what was written where none are given; ``rows`` is the number of chunks."""
        # a bucket's rows go to as many tasks as they need, so that the number of buckets does not bound the tasks
        parts = max(1, -(-rows // (self.buckets * TASK_ROWS)))
        dealt = chunks.repartition(self.buckets * parts, "doc_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)))
        dealt.write.mode("overwrite").partitionBy("doc_bucket").parquet(f"{self.path}/chunks/version={version}")
        if counts is None:
            counts = counted(self.spark.read.schema(chunks.schema).parquet(f"{self.path}/chunks/version={version}"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/version={version}")
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def create(self, corpus: DataFrame) -> CorpusStore:
        """The first version, from texts (chunk_id, doc_id, text)."""
        rows = narrowed(corpus).withColumn("doc_bucket", bucket_of("doc_id", self.buckets))
        held = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("doc_bucket"), F.lit(0).alias("at"))
        self._publish(0, rows, None, held, corpus.count())
        return self

    def replace(self, incoming: DataFrame | None, gone: DataFrame | None = None) -> int:
        """A new version in which the documents of ``incoming`` have its chunks only and those of ``gone`` (doc_id) have none; its number.

        Buckets without such a document are not read or written, and counts change by the chunks that leave and come alone.
        """
        last = self._version(None)
        now = self._chunks(last)
        columns = [c for c in now.columns if c != "doc_bucket"]
        if incoming is None:
            fresh = now.where(F.lit(False))
        else:
            fresh = written(narrowed(incoming)).select(*columns).withColumn("doc_bucket", bucket_of("doc_id", self.buckets))
        ids = fresh.select("doc_id") if gone is None else fresh.select("doc_id").unionByName(gone.select("doc_id"))
        ids = written(ids.distinct().withColumn("doc_bucket", bucket_of("doc_id", self.buckets)))
        touched = ids.select("doc_bucket").distinct()
        old = now.join(F.broadcast(touched), "doc_bucket", "left_semi")  # as many rows as buckets at most
        leaving = written(old.join(small_side(ids.select("doc_id")), "doc_id", "left_semi").select(*columns))
        kept = old.join(small_side(ids.select("doc_id")), "doc_id", "left_anti")
        held = self._held(last).join(touched.withColumn("new", F.lit(True)), "doc_bucket", "left")
        held = held.select("doc_bucket", F.when(F.col("new"), last + 1).otherwise(F.col("at")).alias("at"))
        now_held = kept.select(*fresh.columns).unionByName(fresh)
        self._publish(last + 1, now_held, changed_counts(self.counts(last), leaving, fresh), held, now_held.count())
        return last + 1

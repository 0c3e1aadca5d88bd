"""Writing chunk tables, answer logs and exports."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.session import small_side, written


def bucket_of(key: str, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")


def write_chunks(chunks: DataFrame, path: str, n_buckets: int = 256) -> None:
    """A chunk table laid out by document bucket."""
    chunks.withColumn("doc_bucket", bucket_of("doc_id", n_buckets)).write.mode("overwrite").partitionBy("doc_bucket").parquet(path)


def upsert_chunks(spark: SparkSession, path: str, incoming: DataFrame, n_buckets: int = 256) -> None:
    """Replace the chunks of the incoming documents; only their buckets are rewritten.

    The new state is staged first: a bucket cannot be read and overwritten in one job, and
    a retry must find the old files whole.
    """
    fresh = incoming.withColumn("doc_bucket", bucket_of("doc_id", n_buckets))
    touched = fresh.select("doc_bucket").distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), "doc_bucket", "left_semi")
    kept = old.join(small_side(fresh.select("doc_id").distinct()), "doc_id", "left_anti")
    staged = written(kept.select(*fresh.columns).unionByName(fresh))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def persist_answers(tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Write one run's tables so that they appear together; the attempt's name.

    Every attempt has folders of its own. The table of finished runs, written last, names the attempt that counts for a run, and
    :func:`finished` reads nothing else: an attempt that died, or the one that a repeated run replaces, is never seen beside it.
    """
    attempt = uuid.uuid4().hex
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{root}/{name}")
    done = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"))
    done.coalesce(1).write.mode("append").parquet(f"{root}/{FINISHED}")
    return attempt


FINISHED = "finished_runs"


def finished_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, attempt) of the finished runs, the last finished attempt of each; empty where none is."""
    try:
        rows = spark.read.parquet(f"{root}/{FINISHED}").select("*", "_metadata.file_modification_time", "_metadata.file_path")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run_id string, attempt string")
    return rows.groupBy("run_id").agg(F.max_by("attempt", F.struct("file_modification_time", "file_path")).alias("attempt"))


def finished(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table's rows of finished runs."""
    rows = spark.read.parquet(f"{root}/{name}")
    rows = rows.withColumn("run_id", F.col("run_id").cast("string")).withColumn("attempt", F.col("attempt").cast("string"))
    return rows.join(small_side(finished_runs(spark, root)), ["run_id", "attempt"]).select(*[c for c in rows.columns if c != "attempt"])


def sweep(spark: SparkSession, root: str, names: list[str]) -> int:
    """Remove the attempts that no finished run counts; how many folders went. Not while a run is being written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {(r.run_id, r.attempt) for r in finished_runs(spark, root).toLocalIterator()}
    gone = 0
    for name in names:
        found = files.globStatus(hadoop.Path(f"{root}/{name}/run_id=*/attempt=*"))
        for status in found or []:
            at = status.getPath()
            if (unquote(at.getParent().getName()[7:]), at.getName()[8:]) not in kept:
                gone += files.delete(at, True)
    return gone


def conversation_title(query: Column) -> Column:
    return F.substring(query, 1, 60)


def _document(messages: DataFrame, opening: Column, body: Column, closing: Column) -> DataFrame:
    """(conv_id, seq, block): the opening, each message in turn order, the closing."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = messages.withColumn("seq", F.row_number().over(order).cast("long"))
    ends = messages.groupBy("conv_id").agg((F.count(F.lit(1)) + 1).alias("last"))
    pairs = F.array(F.struct(F.lit(0).cast("long").alias("seq"), opening.alias("block")), F.struct(F.col("last").alias("seq"), closing.alias("block")))
    return m.select("conv_id", "seq", body.alias("block")).unionByName(ends.select("conv_id", F.inline(pairs)))


def export_markdown(messages: DataFrame, title: str, footer: str, citations: DataFrame | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as ordered blocks of Markdown (conv_id, seq, block).

    A conversation is one document of any length and no row gathers it; :func:`write_documents`
    puts its blocks into one file. ``citations``: conv_id, turn, citation_index, line.
    """
    head = F.when(F.col("role") == "user", "### Query").otherwise("### Answer")
    body = F.concat(head, F.lit(":\n"), F.col("text"), F.lit("\n"))
    m = messages
    if citations is not None:
        lines = F.array_sort(F.collect_list(F.struct("citation_index", "line")))
        cited = citations.groupBy("conv_id", "turn").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("cites"))
        m = m.join(cited, ["conv_id", "turn"], "left")
        body = F.concat(body, F.when((F.col("role") == "assistant") & F.col("cites").isNotNull(),
                                     F.concat(F.lit("\n#### Citations:\n"), F.col("cites"), F.lit("\n"))).otherwise(""))
    opening = F.concat(F.lit(f"# {title}\n**Conversation**: `"), "conv_id", F.lit("`\n\n---\n"))
    return _document(m, opening, body, F.lit(f"---\n\n> {footer}"))


def export_json(messages: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """Conversations as ordered blocks that make one JSON object each, citations inside their message."""
    m, fields = messages, ["turn", "role", F.col("text").alias("content")]
    if citations is not None:
        lines = F.array_sort(F.collect_list(F.struct("citation_index", "line")))
        m = m.join(citations.groupBy("conv_id", "turn").agg(lines.alias("citations")), ["conv_id", "turn"], "left")
        fields.append("citations")
    body = F.concat(F.when(F.col("seq") > 1, ",").otherwise(""), F.to_json(F.struct(*fields)))
    opening = F.concat(F.lit('{"id": '), F.to_json(F.struct("conv_id")).substr(F.lit(12), F.lit(1 << 30)))
    opening = F.concat(F.regexp_replace(opening, r"\}$", ""), F.lit(', "messages": ['))
    return _document(m, opening, body, F.lit("]}"))


def write_documents(blocks: DataFrame, path: str) -> None:
    """One text file per conversation: blocks are sorted on disk where need be and written one by one."""
    laid = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    laid.select("conv_id", F.col("block").alias("value")).write.mode("overwrite").partitionBy("conv_id").text(path)

"""Session settings, size checks and the shared folder used by every operator."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def build_session(app: str = "quirefold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; the caller's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only in a local session,
    where driver and tasks are one process, a temporary folder stands in; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quirefold-")
    return f"{root.rstrip('/')}/quirefold-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Used where several jobs read one expensive intermediate; unlike a cached or
    locally checkpointed table it outlives lost executors.
    """
    path = shared_dir(df.sparkSession)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left: the driver's cleaner drops their shuffle files and broadcasts when garbage is collected.

    By itself that happens once in half an hour (spark.cleaner.periodicGC.interval), in which an iterative job can run hundreds of
    stages; such jobs call this once a round. What planning and compiling those stages left free in the driver's native memory goes back too.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> str | None:
    """Have the driver's Java give freed native memory back, as :func:`tidy` does in Python workers, and return what it says of it.

    This is Java's own management command ``System.trim_native_heap`` (Linux, Java 17.0.9 and later); elsewhere nothing happens. It is
    looked up by its public interface, as the class behind it is closed to callers.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.Object, 0), array(jvm.String, 0)
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    return None


def tidy(run):
    """An Arrow pass that gives freed memory back when its partition ends; workers are reused and would keep it."""

    @functools.wraps(run)
    def passed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return passed


SMALL_TABLE_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal out a scanned table of at most 64 MB, which is often a single row group, over the cores.

    The bound is on the files' bytes and not on the number of cores, so no larger table is shuffled.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = int(str(size)) <= SMALL_TABLE_BYTES
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def sized_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As :func:`small_side`, but above the bound neither side of the join is broadcast.

    For joins whose other side is made by exploding rows: the planner tells its size by the bytes of the files it comes from, and would
    gather many times as much in the driver.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` rows, else as it is.

    The check reads no more than ``max_rows + 1`` rows. Above the bound the join is left
    to a shuffle join, which adaptive execution splits where a key is skewed.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

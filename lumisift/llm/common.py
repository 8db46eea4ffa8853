"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.session import checkpoint_dir
from lumisift.shipping import ship

ship(__name__)

#: Bytes of a row group. A task holds one while it writes and one while it reads, the latter on the heap and in direct buffers too; Spark's own 128 MB, which
#: files reach as tables grow, would be most of an executor.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in this session's own folder of the shared one (spark.checkpoint.dir), which is removed when the driver's Python ends."""
    context = spark.sparkContext
    if not hasattr(context, "_lumisift_llm_scratch"):
        context._lumisift_llm_scratch = f"{checkpoint_dir(spark).rstrip('/')}/lumisift-{uuid.uuid4().hex}"
        atexit.register(_at_exit, spark)
    return f"{context._lumisift_llm_scratch}/{what}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Remove what this session's operators wrote for themselves; frames that they returned can't be read any more."""
    at = getattr(spark.sparkContext, "_lumisift_llm_scratch", None)
    if at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    from py4j.protocol import Py4JError

    with contextlib.suppress(Py4JError, OSError):  # the JVM has gone, and what it ran with
        remove_scratch(spark)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: it is computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[Column], what: str, least: int = 1, each: int = 200_000) -> DataFrame:
    """df, written, with `part`: the number of the range of the order in which a row lies, each of about `each` rows.

    Ranges are cut at sampled rows, and written with them, as another run of the plan would cut elsewhere. An order without large ties
    gives ranges of like size, so sums by range and then within each are running sums over all rows that no task gathers.
    """
    parts = max(least, -(-df.count() // each))
    return materialise(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), what)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound what a Python worker is handed at once: Spark's own bound, 64 MB for each task and direction, is much for small executors.

    Changes the session's setting only where it is Spark's default.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).startswith("67108864"):
        spark.conf.set(key, str(size))


class Shared:
    """An object broadcast with its code, so that executors need no copy of this package. A worker keeps the newest of each name only."""

    def __init__(self, spark: SparkSession, name: str, value):
        from pyspark import cloudpickle

        self.name, self.token = name, uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        import pickle

        kept = worker_cache("shared", dict)
        if kept.get(self.name, ("",))[0] != self.token:
            kept[self.name] = (self.token, pickle.loads(self.data.value))
        return kept[self.name][1]


def tidied(run):
    """A function over batches that gives freed memory back to the system when a task ends."""

    def whole(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return whole


def worker_cache(key, build):
    """What a Python worker keeps between tasks."""
    kept = sys.__dict__.setdefault("_lumisift_kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]

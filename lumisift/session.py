"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lumisift", master: str | None = None, **conf: str) -> SparkSession:
    """UTC (capture times have no zone), adaptive execution, Arrow. Partition counts are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where none is set and the master is local (tests).

    Checkpoints are Spark's to remove: set spark.cleaner.referenceTracking.cleanCheckpoints, or clear the folder when no job runs.
    """
    import tempfile

    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_lumisift_checkpoints", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = context._lumisift_checkpoints = "file://" + tempfile.mkdtemp(prefix="lumisift-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base

"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on for results or for skew handling; sizing
# (executors, memory, shuffle partitions) is left to the cluster.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Evidence lies in a folder per file. By default up to 10,000 tasks list such folders, a few each, and mostly wait to be started.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # The wide event projections compile to one very long method, which the JVM would only
    # interpret. Above this size Spark splits them into methods the JIT does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Only settable while a session is built. Recording the call site of every column doubles the
# time to build a plan.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "casewise", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench script."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**SESSION_SETTINGS, **BUILD_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only on a ``local`` master with the setting
    unset; on a cluster an unset folder is an error, since executors could
    not read each other's files.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="casewise-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """An intermediate result written as a table in the shared folder.

    It survives the loss of executors, cuts the lineage, and has its true size as statistics.
    (A reliable checkpoint carries the size estimate of its plan along, which grows without
    bound when a loop joins the result of the round before.)
    """

    def __init__(self, df: DataFrame, name: str = "scratch"):
        spark = df.sparkSession
        self.path = scratch_path(spark, name)
        # Ids are hexadecimal digits, of which the default compression makes little less.
        df.write.option("compression", "zstd").parquet(self.path)
        self.frame = spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        """Delete the files; frames made from this one must not be used any more."""
        spark = self.frame.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str = "scratch") -> DataFrame:
    """Write a frame that several later steps read, and read it back.

    The table is columnar, so the later steps read only what they need. The folder belongs to
    the caller, who clears it when the work is done.
    """
    return Scratch(df, name).frame


def checkpoint_laid_out(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Reliable checkpoint hash-partitioned by the keys; later joins on them do not shuffle it again.

    The frame is written first. Only the repartitioning itself is planned without adaptive
    execution, which would hide the partitioning from the checkpoint.
    """
    stored = materialize(df, "layout")
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return stored.repartition(partitions, *keys).checkpoint(eager=True)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)

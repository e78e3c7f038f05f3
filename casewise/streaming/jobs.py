"""Continuous ingest, windowed detection and duplicate removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casewise.operators.detect import windowed_counts
from casewise.operators.evidence import dedupe_evidence
from casewise.sources.files import Origin, identify, path_exists

LINE_SCHEMA = "value string"


def line_stream(spark: SparkSession, path: str, glob: str | None = None, layout: str = "case_id long, evidence_id long") -> DataFrame:
    """New text files of a folder as a stream of lines with their place in the file."""
    source = spark.readStream.schema(f"{LINE_SCHEMA}, {layout}" if layout else LINE_SCHEMA)
    if glob:
        source = source.option("pathGlobFilter", glob)
    return source.text(path).select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__block"),
    ).withColumnRenamed("value", "line")


def _once_per_batch(batch: DataFrame, number: int, path: str, keys: tuple[str, ...]) -> None:
    """Write a batch under its number; a repeated batch replaces itself and nothing else."""
    (
        batch.withColumn("ingest_batch", F.lit(number))
        .hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_batch", *keys)
        .parquet(path)
    )


def stream_ingest(
    lines: DataFrame,
    to_events: Callable[[DataFrame, Origin], DataFrame],
    origin: Origin,
    target: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Parse new files into the events table.

    ``to_events`` is a batch parser such as ``text_events``. Parsing happens per batch because
    positions in a file cannot be assigned on an unbounded frame. ``trigger`` is what
    ``DataStreamWriter.trigger`` takes; without it the stream ends when all files are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        _once_per_batch(to_events(identify(batch, origin), origin), number, target, ("case_id",))

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def windowed_brute_force_stream(
    events: DataFrame, threshold: int = 5, minutes: int = 10, lateness: str = "10 minutes",
    by: tuple[str, ...] = ("case_id", "user"),
) -> DataFrame:
    """Windows with at least ``threshold`` failed logons, each reported once when it closes."""
    watched = events.withWatermark("timestamp", lateness)
    return windowed_counts(watched, minutes=minutes, by=by).where(F.col("event_count") >= threshold)


def dedupe_stream(
    files: DataFrame, stored: str, checkpoint: str, order: str = "evidence_id", trigger: dict | None = None
) -> StreamingQuery:
    """Store files whose hash is new in their case.

    Within a batch the first copy is found by a partially aggregated minimum; across batches the
    stored hashes decide, so copies of any age are caught and no operator state grows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = dedupe_evidence(batch, order=order)
        if path_exists(spark, stored):
            known = spark.read.parquet(stored).where(F.col("ingest_batch") < number)
            fresh = fresh.join(known.select("case_id", "sha256"), ["case_id", "sha256"], "left_anti")
        _once_per_batch(fresh, number, stored, ())

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

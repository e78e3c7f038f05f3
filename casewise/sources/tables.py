"""Writers of result tables (Parquet, partitioned by case)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

BY_EVIDENCE = ("case_id", "evidence_id")
BY_CASE = ("case_id",)
# Ids and hashes are hexadecimal digits, which the default compression leaves nearly as long.
COMPRESSION = "zstd"


def _drop(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _replace_partitions(df: DataFrame, path: str, keys: Sequence[str], layout: Sequence[str], parsed: DataFrame | None = None) -> None:
    """Overwrite only the partitions that the frame has rows for, then delete those of ``parsed`` (the keys) that it has none for.

    The new rows are there before any old ones without a successor go. The rebalance hint gives every partition few files, while a partition with a large share
    of the rows is still written by many tasks.
    """
    (
        df.hint("rebalance", *keys)
        .sortWithinPartitions(*keys, *layout)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy(*keys)
        .parquet(path)
    )
    if parsed is not None:
        without = parsed.select(*keys).distinct().join(df.select(*keys).distinct(), list(keys), "left_anti")
        for row in without.toLocalIterator():
            _drop(df.sparkSession, "/".join([path, *(f"{k}={row[k]}" for k in keys)]))


def write_events(events: DataFrame, path: str, parsed: DataFrame | None = None) -> None:
    """Replace the stored events of each evidence file in the frame; sorted by time for pruning.

    ``parsed`` (case_id, evidence_id) names the evidence that was read: files that now give no event lose their old ones.
    """
    _replace_partitions(events, path, BY_EVIDENCE, ["timestamp"], parsed)


def write_normalized(normalized: DataFrame, path: str, parsed: DataFrame | None = None) -> None:
    """As ``write_events``, for normalized events."""
    _replace_partitions(normalized, path, BY_EVIDENCE, ["timestamp_utc"], parsed)


def write_graph(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, folder: str, cases: DataFrame | None = None) -> None:
    """Replace the stored graph of each case in the frames; of the ``cases`` (case_id) without one the old graph goes."""
    _replace_partitions(nodes, f"{folder}/nodes", BY_CASE, ["node_type", "node_label"], cases)
    _replace_partitions(edges, f"{folder}/edges", BY_CASE, ["edge_type"], cases)
    _replace_partitions(metadata, f"{folder}/metadata", BY_CASE, [], cases)


def write_validation(summary: DataFrame, records: DataFrame, folder: str) -> None:
    """Append one result row per case and the rows of its failures."""
    summary.write.mode("append").parquet(f"{folder}/results")
    records.write.mode("append").parquet(f"{folder}/records")


def append_custody(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def drop_case(spark: SparkSession, path: str, case_id: int) -> bool:
    """Delete the stored partition of a case."""
    return _drop(spark, f"{path}/case_id={case_id}")

"""Inventory of evidence files with their hashes."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.operators.evidence import content_hashes
from casewise.sources.files import reader


def evidence_inventory(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Path, name, size and SHA-256, SHA-1 and MD5 of each file."""
    files = reader(spark, glob).format("binaryFile").load(path)
    kept = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select(
        *kept,
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        *content_hashes(F.col("content")),
    )


def hash_records(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """Size and hashes of a text or binary column, for files that are stored as rows."""
    body = F.col(content)
    return df.select(*keep, F.octet_length(body).cast("long").alias("size"), *content_hashes(body.cast("binary")))

"""Common parts of the file readers: identity and position. Files of any size are read.

Files are addressed either by a partition layout (``.../case_id=3/evidence_id=17/auth.log``),
which Spark turns into columns by itself, or by constants given to the reader. Without an
evidence id the hash of the file's path is used.

``seq`` is the position of a record in its file: it grows along the file and is unique, but
it is not consecutive. It is made of the start of the file split (in MiB) and the position
inside the task, so a large file can be read by many tasks without a shuffle. Splits must
not be smaller than 1 MiB; Spark's own minimum is 4 MiB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INDEX_BITS = 33
# Folders or files of one read in batches: the driver has an index of these only.
AT_ONCE = 20_000


@dataclass(frozen=True)
class Origin:
    """Where the case and evidence ids of a read come from, and the time used for bad timestamps."""

    case_id: int | None = None
    evidence_id: int | None = None
    ingest_ts: str = "1970-01-01 00:00:00"

    def ingest_time(self) -> Column:
        return F.lit(self.ingest_ts).cast("timestamp")


def any_case_glob(extensions: list[str]) -> str:
    """A file-name pattern for the extensions in any letter case."""
    forms = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return f"*.{{{','.join(forms)}}}" if len(forms) > 1 else f"*.{forms[0]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def literal_path(listed: str) -> str:
    """A path as Spark lists it (URL-encoded) in the form that reads exactly this file."""
    return escaped_path(unquote(listed))


def escaped_path(plain: str) -> str:
    """A path in the form that reads exactly it, whatever signs it has."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", plain)


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder that Spark would not take as hidden."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    paths = spark._jvm.scala.runtime.ScalaRunTime.genericWrapArray(spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    names = []
    for start in range(0, paths.size(), AT_ONCE):
        names += [p.rsplit("/", 1)[1] for p in paths.slice(start, start + AT_ONCE).mkString("\0").split("\0")]
    return [n for n in names if not n.startswith((".", "_")) or (n.startswith("_") and "=" in n)]


def _last_folders(spark: SparkSession, root: str) -> list[tuple[str, list[str]]]:
    """The folders that hold the last level of a partition layout below ``root``, with the names in it; none where the layout is not regular."""
    level = [root]
    while True:
        inner = [(folder, [n for n in names if "=" in n], len(names)) for folder in level for names in [_names(spark, folder)]]
        # Files beside the first folders are no part of the layout, for Spark neither.
        if any(len(parts) != n and folder != root for folder, parts, n in inner) or not any(parts for _, parts, _ in inner):
            return []
        keys = {n.split("=", 1)[0] for _, parts, _ in inner for n in parts}
        if len(keys) != 1:
            return []
        probe = next(f"{folder}/{parts[0]}" for folder, parts, _ in inner if parts)
        if not is_folder(spark, probe):
            return []
        if not any("=" in n for n in _names(spark, probe)):
            return [(folder, parts) for folder, parts, _ in inner]
        level = [f"{folder}/{n}" for folder, parts, _ in inner for n in parts]


def file_batches(spark: SparkSession, path) -> Iterator[tuple[str | list[str], dict[str, str]]]:
    """What to read and the options for it, so that a partition layout of any number of folders is read ``AT_ONCE`` folders at a time.

    The driver holds the folders' names, no index of all files. Other paths are one batch: lists and patterns, and folders without the layout.
    """
    if isinstance(path, str) and escaped_path(path) == path and path_exists(spark, path) and is_folder(spark, path):
        root = path.rstrip("/") or path
        last = _last_folders(spark, root)
        if sum(len(names) for _, names in last) > AT_ONCE:
            batch = []
            for folder, names in last:
                for name in names:
                    batch.append(escaped_path(f"{folder}/{name}"))
                    if len(batch) == AT_ONCE:
                        yield batch, {"basePath": path}
                        batch = []
            if batch:
                yield batch, {"basePath": path}
            return
    yield path, {}


def reader(spark: SparkSession, glob: str | None = None):
    source = spark.read
    return source.option("pathGlobFilter", glob) if glob else source


def with_identity(df: DataFrame, origin: Origin, keep_block: bool = False) -> DataFrame:
    """Add case_id, evidence_id, seq and path to rows that still have ``_metadata``; if asked, the start of the split as ``block`` and the file's ``size``."""
    block = F.col("_metadata.file_block_start")
    located = df.withColumn("path", F.col("_metadata.file_path")).withColumn("__block", block)
    if keep_block:
        located = located.withColumn("block", block).withColumn("size", F.col("_metadata.file_size"))
    return identify(located, origin)


def identify(located: DataFrame, origin: Origin) -> DataFrame:
    """The same for rows that carry ``path`` and ``__block`` as columns."""
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    seq = F.shiftleft(F.shiftright(F.col("__block"), 20), _INDEX_BITS).bitwiseOR(index)
    if origin.case_id is not None:
        case = F.lit(origin.case_id).cast("long")
    elif "case_id" in located.columns:
        case = F.col("case_id").cast("long")
    else:
        raise ValueError("give case_id or use a case_id=... folder layout")
    if origin.evidence_id is not None:
        evidence = F.lit(origin.evidence_id).cast("long")
    elif "evidence_id" in located.columns:
        evidence = F.col("evidence_id").cast("long")
    else:
        evidence = F.xxhash64("path")
    return (
        located.withColumn("seq", seq)
        .withColumn("__case", case)
        .withColumn("__evidence", evidence)
        .drop("__block", "case_id", "evidence_id")
        .withColumnsRenamed({"__case": "case_id", "__evidence": "evidence_id"})
    )


def read_lines(
    spark: SparkSession,
    path,
    origin: Origin,
    glob: str | None = None,
    separator: str | None = None,
    where: Column | None = None,
    keep_block: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """One row per line (or per ``separator``) with its identity; large files are split. ``where`` picks files by ``_metadata``."""
    source = reader(spark, glob).options(**(options or {}))
    if separator:
        source = source.option("lineSep", separator)
    lines = source.text(path)
    lines = lines if where is None else lines.where(where)
    return with_identity(lines, origin, keep_block).withColumnRenamed("value", "line")


def in_few_tasks(files: DataFrame) -> DataFrame:
    """The rows of a file scan in as many tasks as its bytes need, or as there are cores; by itself Spark starts a task for a few small files."""
    spark = files.sparkSession
    plan = files._jdf.queryExecution().optimizedPlan()
    size, most = int(plan.collectLeaves().head().stats().sizeInBytes()), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return files.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // most)))


def read_contents(spark: SparkSession, path, origin: Origin, glob: str | None = None) -> DataFrame:
    """One row per file with its bytes."""
    files = reader(spark, glob).format("binaryFile").load(path)
    return identify(files.withColumn("__block", F.lit(0).cast("long")), origin)


def split_runs(batch: pa.RecordBatch, end: str) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, block, first row, bytes) of the rows of one split after another, every ``text`` with its end sign again.

    Pieces are many and short, so they are joined as a column, never one by one.
    """
    if not len(batch):
        return
    path, block = batch.column("path"), batch.column("block")
    joined = pc.binary_join_element_wise(batch.column("text"), pa.scalar(end.encode(), pa.binary()), pa.scalar(b"", pa.binary()))
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    data = memoryview(joined.buffers()[2])
    other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1]))
    starts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)]
    for start, stop in zip(starts, starts[1:]):
        yield path[start].as_py(), block[start].as_py(), start, data[offsets[start] : offsets[stop]].tobytes()

"""Result tables that change all at once: new files first, then one rename.

A table is a folder with the rows of every write (``data/<part>/__version=...``, each file sorted by case) and numbered lists of what is live
(``live/<number>``: the keys, evidence or case, and the version that holds their rows). A write adds its files, then renames a new
list into place. Until then readers see the old rows, afterwards the new ones, of all parts of the table together; a writer that is lost
before the rename changes nothing. The rename fails where another writer was faster; the list is then made anew from theirs, so
writers of different evidence do not undo each other. This needs a file system whose rename is atomic, such as HDFS.

Rows that are no longer live stay until ``compact``, which must not run while old numbers are still read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.operators.skew import broadcast_if_small
from casewise.sources.tables import BY_CASE, BY_EVIDENCE, COMPRESSION

VERSION = "__version"
TRIES = 20


def _children(spark: SparkSession, folder: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _put_in_place(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target is there already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    context = hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    new.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(new.getParent())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(old, new, options)
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" in problem.java_exception.getClass().getName():
            return False
        raise
    return True


def latest(spark: SparkSession, path: str) -> int:
    """Number of the newest list, 0 for a table that is not there."""
    return max((int(name) for name in _children(spark, f"{path}/live") if name.isdigit()), default=0)


def _live(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/live/{number}")


def write(parts: Mapping[str, DataFrame], path: str, keys: Sequence[str], layout: Mapping[str, Sequence[str]], replaced: DataFrame | None = None) -> int:
    """Replace the rows of all keys in ``parts`` and in ``replaced``, in every part at once; gives the number of the new list.

    Every task sorts and writes the rows that it has: a reader of one case skips the rest of a file by its statistics, and no row is
    moved for that. Keys must not be null. Keys in ``replaced`` alone (evidence that now gives no rows) have none afterwards.
    """
    spark = next(iter(parts.values())).sparkSession
    version = f"v{uuid.uuid4().hex}"
    found = None
    for name, rows in parts.items():
        folder = f"{path}/data/{name}/{VERSION}={version}"
        rows.sortWithinPartitions(*keys, *layout.get(name, [])).write.option("compression", COMPRESSION).parquet(folder)
        written = spark.read.schema(rows.schema).parquet(folder).select(*keys)
        found = written if found is None else found.unionByName(written)
    fresh = found.distinct()
    gone = fresh if replaced is None else fresh.unionByName(replaced.select(*keys)).distinct()
    # A row without keys names the newest version, whose files give the schema of a table without rows.
    marker = spark.range(1).select(*[F.lit(None).cast(fresh.schema[k].dataType).alias(k) for k in keys])
    for _ in range(TRIES):
        number = latest(spark, path)
        listed = fresh.unionByName(marker).withColumn(VERSION, F.lit(version))
        if number:
            old = _live(spark, path, number).where(F.col(keys[0]).isNotNull())
            listed = listed.unionByName(old.join(gone, list(keys), "left_anti"))
        made = f"{path}/making-{uuid.uuid4().hex}"
        listed.write.parquet(made)
        if _put_in_place(spark, made, f"{path}/live/{number + 1}"):
            return number + 1
        _delete(spark, made)
    raise RuntimeError(f"{path}: other writers were faster {TRIES} times")


def read(spark: SparkSession, path: str, part: str, number: int | None = None) -> DataFrame:
    """The live rows of one part; with a ``number``, as of that list. The frame keeps to it while others write."""
    number = number or latest(spark, path)
    if not number:
        raise ValueError(f"{path} has no rows yet")
    live = _live(spark, path, number)
    keys = [c for c in live.columns if c != VERSION]
    base = f"{path}/data/{part}"
    # One name per write since the last ``compact``.
    folders = [f"{base}/{VERSION}={r[VERSION]}" for r in live.select(VERSION).distinct().toLocalIterator()]
    rows = spark.read.option("basePath", base).parquet(*sorted(folders))
    return rows.join(broadcast_if_small(live), [*keys, VERSION], "left_semi").drop(VERSION)


def compact(spark: SparkSession, path: str, layout: Mapping[str, Sequence[str]]) -> int:
    """Write the live rows of all parts together as one version, then delete what only older lists name.

    No other writer may be at work: keys it adds meanwhile stay, but its unlisted files would be deleted.
    """
    number = latest(spark, path)
    keys = [c for c in _live(spark, path, number).columns if c != VERSION]
    parts = {name: read(spark, path, name, number) for name in _children(spark, f"{path}/data")}
    now = write(parts, path, keys, layout)
    kept = {r[VERSION] for r in _live(spark, path, now).select(VERSION).distinct().toLocalIterator()}
    for old in _children(spark, f"{path}/live"):
        if old.isdigit() and int(old) < now:
            _delete(spark, f"{path}/live/{old}")
    for name in parts:
        for folder in _children(spark, f"{path}/data/{name}"):
            if folder.removeprefix(f"{VERSION}=") not in kept:
                _delete(spark, f"{path}/data/{name}/{folder}")
    return now


EVENTS = {"events": ["timestamp"]}
GRAPH = {"nodes": ["node_type", "node_label"], "edges": ["edge_type"], "metadata": []}


def commit_events(events: DataFrame, path: str, parsed: DataFrame | None = None) -> int:
    """Replace the events of each evidence file in the frame and of all in ``parsed`` (case_id, evidence_id), at once."""
    return write({"events": events}, path, BY_EVIDENCE, EVENTS, parsed)


def commit_graph(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str, cases: DataFrame | None = None) -> int:
    """Replace nodes, edges and metadata of each case in the frames and of all in ``cases`` (case_id), all three at once."""
    return write({"nodes": nodes, "edges": edges, "metadata": metadata}, path, BY_CASE, GRAPH, cases)

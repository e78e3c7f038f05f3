"""Helpers that the operators of this package share: sessions, tasks, table access, links to components."""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.session import Scratch, configure

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Rows and bytes of one Arrow batch: texts are long, and a task holds one batch at a time.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The library's run-time settings and the Arrow batch size of this package."""
    configure(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES),
    ):
        if spark.conf.get(key, None) != str(value):
            spark.conf.set(key, str(value))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def task(function: Callable, *arguments) -> Callable[[Iterator], Iterator]:
    """``function(batches, *arguments)`` for mapInArrow; a worker imports it by name, so its module's tables are built once."""
    module, name, root = function.__module__, function.__name__, ROOT

    def run(batches):
        if root not in sys.path:
            sys.path.insert(0, root)
        yield from getattr(importlib.import_module(module), name)(batches, *arguments)

    return run


def group_task(function: Callable, *arguments) -> Callable:
    """As ``task``, for applyInArrow: ``function(table, *arguments)`` returns a table."""
    module, name, root = function.__module__, function.__name__, ROOT

    def run(rows):
        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(rows, *arguments)

    return run


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


class Workspace:
    """Intermediate tables of a job in the shared folder, deleted together once nothing reads them any more."""

    def __init__(self):
        self._held: list[Scratch] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._held.append(Scratch(df, name))
        return self._held[-1].frame

    def clear(self) -> None:
        while self._held:
            self._held.pop().discard()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; ``links`` has long columns u and v, root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each is a partially
    aggregated minimum and an equi-join that adaptive execution may split. The links of a round
    are a table in the shared folder, deleted after the next; the result is one too. Null ids and links to itself are left out; no link, no row.
    """
    pairs = links.where(F.col("u") != F.col("v"))
    held = Scratch(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = held.frame.unionByName(held.frame.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        near = large.join(least, "u")
        small = near.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = Scratch(small.unionByName(near.select("u", F.col("low").alias("v"))).distinct(), "links")
        held.discard()
        held = moved
        now = held.frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = held.frame.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = held.frame.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = Scratch(found.unionByName(tops), "roots").frame
    held.discard()
    return out

"""Exact duplicates by two passes over hashes with a Bloom filter between them.

*Digests.* Each text is read once: its SHA-256 after lower-casing A-Z is written with the row's id, a row number and the
slice of hash values that it belongs to, each of which has at most about ``FILTER_ROWS`` rows. Slices are worked on one after the other.

*First pass.* Every task sets the bits of its digests in a blocked Bloom filter (``PROBES`` bits in one block of
``BLOCK`` bits) and keeps the bits set once and those set more often apart. Tasks' filters are joined block by block: a bit that two tasks set was set
more often. What is left is the filter of the bits set more than once; it has at most ``BITS`` bits for each row of
a slice, so it can be broadcast.

*Second pass.* A row may be repeated only if all its bits were set more than once. Other rows, and the few that only look repeated
aside, nothing moves: they are groups of one and pass straight through. Rows that may be repeated are grouped by the whole digest,
partially aggregated. Of their groups, those with more than a ``HEAVY``-th of all rows, fewer than ``HEAVY``, are
broadcast back to their rows; no other group is large.

Null texts count as empty, and empty texts are equal. Null ids are smaller than every other id. Of rows with equal text and id one stays. An empty
table gives no rows. Other columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import Workspace, prepare, task
from casewise.llm.texts import LOWER, strings
from casewise.session import scratch_path

# Rows and bits a row of one filter: 128 MB at most.
FILTER_ROWS, BITS = 1 << 26, 16
BLOCK, PROBES = 4096, 3
# Bits of a digest's number that choose its block; the others choose its places in the block.
BLOCK_NUMBER = 27
HEAVY = 1000
# Places that a task holds before it hands its bits on.
HELD = 1 << 22

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH digests AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{A_TO_Z}', '{A_TO_Z.lower()}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)
"""


def digest(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """doc_id, digest, number (63 bits of the digest) and slice of every row."""
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        raw = LOWER[data].tobytes()
        at = offsets.tolist()
        made = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at, at[1:], strict=False)]
        words = np.frombuffer(b"".join(made), np.uint64).reshape(-1, 4)
        number = (words[:, 0] >> np.uint64(1)).astype(np.int64)
        part = (words[:, 1] % np.uint64(slices)).astype(np.int32)
        columns = [batch.column("doc_id"), pa.array(made, pa.binary()), pa.array(number), pa.array(part)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "number", "slice"])


def places(number: np.ndarray, blocks: int) -> np.ndarray:
    """The bits of each digest as places in the whole filter, one row of ``PROBES`` each, equal ones once (the others are -1)."""
    block = (number & ((1 << BLOCK_NUMBER) - 1)) % blocks * BLOCK
    found = np.stack([block + (number >> (BLOCK_NUMBER + 12 * k) & (BLOCK - 1)) for k in range(PROBES)], axis=1)
    for k in range(1, PROBES):
        found[(found[:, :k] == found[:, k : k + 1]).any(axis=1), k] = -1
    return found


def _by_block(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """Places in ascending order as one row per block; ``twice`` is a part of ``once``."""
    heads = np.flatnonzero(np.diff(once // BLOCK, prepend=-1))
    blocks = once[heads] // BLOCK
    lists = []
    for values in (once, twice):
        at = np.append(np.searchsorted(values, blocks * BLOCK), len(values))
        lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((values % BLOCK).astype(np.int16))))
    return pa.RecordBatch.from_arrays([pa.array(blocks), *lists], ["block", "once", "twice"])


def sketch(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """The places of a task's digests by block: all, and those set by more than one row."""
    held, size = [], 0
    for batch in batches:
        found = places(batch.column("number").to_numpy(zero_copy_only=False), blocks).ravel()
        held.append(found[found >= 0])
        size += len(held[-1])
        if size > HELD:
            once, times = np.unique(np.concatenate(held), return_counts=True)
            yield _by_block(once, once[times > 1])
            held, size = [], 0
    if size:
        once, times = np.unique(np.concatenate(held), return_counts=True)
        yield _by_block(once, once[times > 1])


def join_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits that were set more than once, as 64-bit words, of every block that has one."""
    numbers: dict[int, int] = {}
    times = np.zeros((64, BLOCK), np.uint8)
    for batch in batches:
        rows = np.array([numbers.setdefault(b, len(numbers)) for b in batch.column("block").to_pylist()], np.int64)
        while len(numbers) > len(times):
            times = np.concatenate([times, np.zeros_like(times)])
        flat = times.reshape(-1)
        once, twice = batch.column("once"), batch.column("twice")
        at, set_by = np.unique(np.repeat(rows * BLOCK, once.value_lengths().to_numpy()) + once.flatten().to_numpy(), return_counts=True)
        flat[at] = np.minimum(flat[at] + np.minimum(set_by, 2), 2)
        flat[np.repeat(rows * BLOCK, twice.value_lengths().to_numpy()) + twice.flatten().to_numpy()] = 2
    known = np.array(list(numbers), np.int64)
    often = times[: len(known)] == 2
    some = np.flatnonzero(often.any(axis=1))
    for first in range(0, len(some), 1000):
        rows = some[first : first + 1000]
        words = np.packbits(often[rows], axis=1, bitorder="little").view(np.int64)
        at = pa.array(np.arange(len(rows) + 1) * words.shape[1], pa.int32())
        lists = pa.ListArray.from_arrays(at, pa.array(words.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(known[rows]), lists], ["block", "words"])


def marked(digests: DataFrame, blocks: int) -> DataFrame:
    """The digests with ``maybe``: whether all bits were set more than once."""
    parts = digests.select("number").mapInArrow(task(sketch, blocks), "block long, once array<smallint>, twice array<smallint>")
    often = parts.repartition("block").mapInArrow(task(join_filters), "block long, words array<bigint>")
    number = F.col("number")
    block = number.bitwiseAND((1 << BLOCK_NUMBER) - 1) % F.lit(blocks)
    tested = digests.withColumn("block", block).join(F.broadcast(often), "block", "left")
    maybe = F.col("words").isNotNull()
    for k in range(PROBES):
        place = F.shiftright(number, BLOCK_NUMBER + 12 * k).bitwiseAND(BLOCK - 1)
        word = F.get("words", F.shiftright(place, 6).cast("int"))
        maybe = maybe & (F.getbit(word, place.bitwiseAND(63).cast("int")) == 1)
    return tested.select("row", "doc_id", "digest", maybe.alias("maybe"))


def exact_duplicates(docs: DataFrame, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document.

    ``filter_rows`` bounds the rows, and so the size, of one broadcast filter. Rows are counted first, which of Parquet
    files reads the footers only.
    """
    spark = prepare(docs.sparkSession)
    total = docs.count()
    slices = max(1, -(-total // filter_rows))
    blocks = max(1, -(-total * BITS // (slices * BLOCK)))
    path = scratch_path(spark, "digests")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = texts.mapInArrow(task(digest, slices), "doc_id long, digest binary, number long, slice int")
    read.withColumn("row", F.monotonically_increasing_id()).write.partitionBy("slice").parquet(path)
    digests = spark.read.schema("doc_id long, digest binary, number long, row long, slice int").parquet(path)
    tested = scratch_path(spark, "tested")
    for k in range(slices):
        marked(digests.where(F.col("slice") == k), blocks).write.mode("append").parquet(tested)
    rows = spark.read.schema("row long, doc_id long, digest binary, maybe boolean").parquet(tested)
    repeated = rows.where("maybe")
    top = F.max(F.struct("doc_id", "row")).alias("top")
    groups = Workspace().keep(repeated.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), top), "groups")
    heavy = F.broadcast(groups.where(F.col("group_size") * HEAVY > total))
    others = groups.where(F.col("group_size") * HEAVY <= total)
    grouped = repeated.join(heavy, "digest").unionByName(repeated.join(heavy, "digest", "left_anti").join(others, "digest"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    grouped = grouped.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("top.row") == F.col("row")).alias("kept"), sha)
    single = rows.where(~F.col("maybe"))
    one = F.lit(1).cast("long").alias("group_size")
    return single.select("doc_id", F.col("doc_id").alias("keep_id"), one, F.lit(True).alias("kept"), sha).unionByName(grouped)

"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised, so a cosine of 0.9 is a distance of sqrt(0.2). A hash value of a vector is
floor((a . v + b) / WIDTH) with Gaussian a and uniform b; a table's bucket is given by several such
values together. The number of values per table follows the number of vectors, so that unrelated ones
rarely share a bucket, and the number of tables is what RECALL asks for at the smallest cosine that
links; larger cosines are found more often. Vectors of a bucket are compared by the exact cosine
in double precision, in blocks of bounded size; each pair counts in the first table where both share a
bucket, so nothing is counted twice and no pair leaves a task: it gives counts of links and the
links that join its components.

Equal vectors are one class with a number of copies. Vectors that are null, zero or hold null or
non-finite components link with nothing, nor do vectors of different lengths with each other. A
null vec_id is kept with no links. Repeated rows are copies of each other. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import Workspace, components, group_task, prepare, task
from casewise.session import Scratch

COSINE = 0.9
WIDTH = 2.0
# Wanted share of the pairs at the smallest cosine that links, and unrelated vectors expected in a bucket.
RECALL, CROWD = 0.99, 64
BLOCK = 1024


def _collide(distance: float) -> float:
    """Chance that two vectors at a distance share a hash value."""
    x = WIDTH / distance
    below = math.erfc(x / math.sqrt(2))
    return 1 - below - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(vectors: int) -> tuple[int, int]:
    """(hash values per table, tables) for a number of vectors."""
    values = max(2, round(math.log(max(2.0, vectors / CROWD)) / -math.log(_collide(math.sqrt(2)))))
    together = _collide(math.sqrt(2 - 2 * COSINE)) ** values
    return values, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - together)))


def _matrix(batch: pa.RecordBatch, name: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors in double precision) of each length that occurs."""
    column = batch.column(name)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        out.append((rows, flat[at[rows][:, None] + np.arange(length)]))
    return out


def hash_vectors(batches: Iterator[pa.RecordBatch], values: int, tables: int) -> Iterator[pa.RecordBatch]:
    """a, copies, the unit vector (doubles as bytes) and one bucket key per table."""
    drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for rows, vectors in _matrix(batch, "embedding"):
            size = vectors.shape[1]
            if size not in drawn:
                rng = np.random.default_rng([11, size])
                drawn[size] = rng.standard_normal((size, values * tables)), rng.uniform(0, WIDTH, values * tables)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            gaussian, shift = drawn[size]
            cell = np.floor((unit @ gaussian + shift) / WIDTH).astype(np.int64).reshape(len(rows), tables, values)
            key = np.full((len(rows), tables), size, np.uint64)
            for k in range(values):
                key = (key ^ cell[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(key.view(np.int64).reshape(-1))
            )
            taken = batch.take(pa.array(rows))
            columns = [taken.column("a"), taken.column("copies"), pa.array([u.tobytes() for u in unit], pa.binary()), keys]
            yield pa.RecordBatch.from_arrays(columns, ["a", "copies", "unit", "keys"])


def compare(rows: pa.Table) -> pa.Table:
    """Kind 0: (a, links counted here); kind 1: links (a, b) that join the components found here."""
    number = rows.column("number")[0].as_py()
    a, copies, block = (rows.column(c).to_numpy() for c in ("a", "copies", "block"))
    unit = np.stack([np.frombuffer(x) for x in rows.column("unit").to_pylist()])
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(a), -1)[:, :number]
    links = np.zeros(len(a), np.int64)
    above = np.arange(len(a))

    def top(i):
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    left, right = [], []
    two = (block != block[0]).any()
    for start in range(0, len(a), 512):
        part = slice(start, start + 512)
        i, j = np.nonzero(unit[part] @ unit.T >= COSINE)
        i += start
        keep = i < j
        if two:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        if number:
            first = np.ones(len(i), bool)
            for k in range(0, len(i), 1 << 16):
                some = slice(k, k + (1 << 16))
                first[some] = (keys[i[some]] != keys[j[some]]).all(axis=1)
            i, j = i[first], j[first]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            r, s = top(x), top(y)
            if r != s:
                above[max(r, s)] = min(r, s)
                left.append(a[x])
                right.append(a[y])
    some = np.flatnonzero(links)
    kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(left), np.int32)])
    return pa.table(
        {
            "kind": pa.array(kind),
            "a": pa.array(np.concatenate([a[some], np.array(left, np.int64)])),
            "b": pa.array(np.concatenate([links[some], np.array(right, np.int64)])),
        }
    )


def _usable(column: str):
    values = F.col(column)
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(sound & F.exists(values, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("usable", _usable("embedding"))
    sound = rows.where("usable")
    # A class is known by a hash of its vector, as ids may repeat.
    classes = Scratch(
        sound.groupBy("embedding")
        .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .withColumn("a", F.xxhash64("embedding")),
        "vectors",
    ).frame
    values, tables = plan(classes.count())
    work = Workspace()
    hashed = work.keep(
        classes.select("a", "copies", "embedding").mapInArrow(
            task(hash_vectors, values, tables), "a long, copies long, unit binary, keys array<bigint>"
        ),
        "hashed",
    )
    member = hashed.select("a", "copies", "unit", "keys", F.posexplode("keys").alias("number", "key"))
    sizes = hashed.select(F.posexplode("keys").alias("number", "key")).groupBy("number", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where("n > 1").select("number", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = member.join(crowded, ["number", "key"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = [F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")]
    found = Scratch(
        dealt.select("number", "key", *two, "block", "a", "copies", "unit", "keys")
        .groupBy("number", "key", "first", "second")
        .applyInArrow(group_task(compare), "kind int, a long, b long"),
        "vector-links",
    ).frame
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    work.clear()
    roots = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = (
        classes.join(links, "a", "left")
        .join(roots, classes["a"] == roots["node"], "left")
        .select(
            "embedding",
            "low",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "a").alias("root"),
        )
    )
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(named, "root").select("embedding", "n_links", "component_id")
    linked = sound.select("vec_id", "embedding").join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

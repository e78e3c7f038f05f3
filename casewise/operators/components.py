"""Connected components of the entity graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.skew import attach_group, lookup
from casewise.session import Scratch

LINKS = "case_id long, u string, v string"
# Links that a task joins up at a time.
CHUNK = 500_000


def _joined_up(case: pa.ChunkedArray, u: pa.ChunkedArray, v: pa.ChunkedArray) -> pa.RecordBatch:
    """The components of these links alone, as a link (node, smallest node) of every node but the smallest."""
    n = len(case)
    names = pa.concat_arrays([*u.chunks, *v.chunks]).dictionary_encode()
    place = pc.array_sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    cases, number = np.unique(case.to_numpy(), return_inverse=True)
    key = np.tile(number, 2) * len(place) + rank[names.indices.to_numpy()]
    node, at = np.unique(key, return_inverse=True)
    a, b = at[:n], at[n:]
    low = np.arange(len(node))
    while True:
        least = np.minimum(low[a], low[b])
        moved = low.copy()
        for end in (a, b, low[a], low[b]):
            np.minimum.at(moved, end, least)
        moved = moved[moved]
        if (moved == low).all():
            break
        low = moved
    some = np.flatnonzero(low != np.arange(len(node)))
    text = lambda keys: names.dictionary.take(pa.array(place[keys % len(place)]))
    return pa.RecordBatch.from_arrays([pa.array(cases[node[some] // len(place)]), text(node[some]), text(node[low[some]])], ["case_id", "u", "v"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task joined up, ``CHUNK`` at a time: what was connected stays so, by fewer links."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CHUNK:
            yield _joined_up(*pa.Table.from_batches(held).select(["case_id", "u", "v"]).columns)
            held, size = [], 0
    if size:
        yield _joined_up(*pa.Table.from_batches(held).select(["case_id", "u", "v"]).columns)


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select("case_id", F.col("v").alias("u"), F.col("u").alias("v"))
    return links.select("case_id", "u", "v").unionByName(back)


def _star(links: DataFrame) -> DataFrame:
    """Attach to each link (u, v) the smallest id seen around u, u itself included."""
    low = F.least(F.min("v"), F.min("u")).alias("low")
    return attach_group(links, ["case_id", "u"], [low])


def _large_star(links: DataFrame) -> DataFrame:
    near = _star(_both_ways(links))
    return near.where(F.col("v") > F.col("u")).select("case_id", F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(
        "case_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    near = _star(down)
    pairs = F.array(
        F.when(F.col("v") != F.col("low"), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))),
        F.struct(F.col("u").alias("u"), F.col("low").alias("v")),
    )
    return near.select("case_id", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select(
        "case_id", "p.u", "p.v"
    )


def _measure(links: DataFrame) -> tuple[int, object]:
    """Row count and an order-free fingerprint of the links."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("case_id", "u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _roots(edges: DataFrame) -> DataFrame:
    """(case_id, node_id, root) of every node that has a link to another node and is not the root itself."""
    links = (
        edges.where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull() & (F.col("src_id") != F.col("dst_id")))
        .select("case_id", F.col("src_id").alias("u"), F.col("dst_id").alias("v"))
        .mapInArrow(contract, LINKS)
    )
    held = Scratch(links.repartition("case_id", "u").mapInArrow(contract, LINKS), "links")
    before = _measure(held.frame)
    while True:
        starred = _large_star(held.frame)
        moved = Scratch(_small_star(starred).distinct().mapInArrow(contract, LINKS).distinct(), "links")
        held.discard()
        held = moved
        now = _measure(held.frame)
        if before == now:
            return held.frame.select("case_id", F.col("u").alias("node_id"), F.col("v").alias("root"))
        before = now


def _labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Root of every node; a node without a link is its own."""
    return nodes.join(roots, ["case_id", "node_id"], "left").withColumn(
        "root", F.coalesce(F.col("root"), F.col("node_id"))
    )


def connected_components(
    nodes: DataFrame, edges: DataFrame, leaf_edges: str | None = None
) -> DataFrame:
    """``component_id`` (the smallest node id of the component) for every node of every case.

    Every task first joins up the links that it has, before and after they are dealt by node. Then the large-star and
    small-star steps of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014), alternate, each pair followed by
    the same joining up, until nothing changes. Neighbours are never gathered: a step is a partially
    aggregated minimum and a skew-safe join, and a task joins up ``CHUNK`` links at a time.

    ``leaf_edges`` names an edge type whose source nodes have no other edge, which holds for
    BELONGS_TO in a built graph. Those nodes, one per event, are folded into their target before
    the rounds and take its component afterwards, so the rounds see the other nodes only.
    """
    own = nodes.select("case_id", "node_id")
    if leaf_edges is None:
        return _labelled(own, _roots(edges)).withColumnRenamed("root", "component_id")
    is_leaf = F.coalesce(F.col("edge_type") == leaf_edges, F.lit(False))
    leaves = edges.where(is_leaf).select("case_id", F.col("src_id").alias("node_id"), F.col("dst_id").alias("target"))
    inner = own.join(leaves.select("case_id", "node_id"), ["case_id", "node_id"], "left_anti")
    folded = leaves.groupBy("case_id", F.col("target").alias("node_id")).agg(F.min("node_id").alias("smallest_leaf"))
    rooted = _labelled(inner, _roots(edges.where(~is_leaf))).join(folded, ["case_id", "node_id"], "left")
    smallest = F.min(F.least("node_id", "smallest_leaf")).alias("component_id")
    settled = Scratch(
        attach_group(rooted, ["case_id", "root"], [smallest]).select(
            "case_id", "node_id", "component_id"
        ),
        "components",
    ).frame
    targets = settled.withColumnRenamed("node_id", "target")
    attached = lookup(leaves, targets, ["case_id", "target"])
    return settled.unionByName(attached.select("case_id", "node_id", "component_id"))

"""Skew-safe joins and numbering against plain window functions."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casewise.operators import graph, skew
from casewise.operators.ranking import number_rows, page, top_per_group, total_matches
from casewise.operators.skew import SPREAD, attach_group, lookup
from conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some keys are null, the rest are small groups."""
    rng = random.Random(7)
    data = [(i, "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randrange(300)}", rng.randrange(50)) for i in range(6000)]
    return spark.createDataFrame(data, "id long, key string, t int").repartition(6)


def test_attach_group(skewed):
    got = attach_group(skewed, ["key"], [F.count(F.lit(1)).alias("n"), F.min("id").alias("first")])
    w = Window.partitionBy("key")
    want = skewed.select(
        "*",
        F.when(F.col("key").isNotNull(), F.count(F.lit(1)).over(w)).alias("n"),
        F.when(F.col("key").isNotNull(), F.min("id").over(w)).alias("first"),
    )
    assert rows(got) == rows(want)


def test_many_equal_hot_keys(spark):
    """5,000 keys of equal weight beside one that holds a third of the rows."""
    frame = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("key"))
    got = attach_group(frame, ["key"], [F.count(F.lit(1)).alias("n")])
    assert rows(got.groupBy("key").agg(F.max("n"), F.count("*")).where("key = -1")) == [(-1, 10_000, 10_000)]
    assert got.where("n IS NULL").count() == 0


def test_lookup(spark, skewed):
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "key string, v int")
    got = lookup(skewed, table, ["key"])
    want = skewed.join(table, "key", "left").select("id", "key", "t", "v")
    assert rows(got) == rows(want)


def test_hot_keys_are_dealt_out(skewed):
    """Both inputs of the join are shuffled by key and spread, and no piece of the hot key is large."""
    spark = skewed.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_group(skewed, ["key"], [F.count(F.lit(1)).alias("n")])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\((?:__spread#\d+, key|__of_spread#\d+, __of_key|key#\d+, __spread|__of_key#\d+, __of_spread)", plan)) == 2
    spread = F.pmod(F.xxhash64("id", "t"), F.lit(SPREAD))
    biggest = skewed.groupBy("key", spread.alias("s")).count().agg(F.max("count")).first()[0]
    assert biggest < 2 * 2000 / SPREAD


def test_number_rows(skewed):
    got = number_rows(skewed, ["key"], [F.col("t").asc_nulls_first(), F.col("id").asc()], "n")
    want = skewed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("t", "id")).cast("long"))
    known = F.col("key").isNotNull()
    assert rows(got.where(known)) == rows(want.where(known))


def test_top_per_group_limits_before_the_shuffle(skewed):
    top = top_per_group(skewed, ["key"], [F.col("id")], 3, "n")
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert rows(top.where("key = 'hot'"), "id", "n") == [(0, 1), (3, 2), (6, 3)]


def test_page_and_total(skewed):
    assert [r["id"] for r in page(skewed, [F.col("id")], 10, 3).collect()] == [10, 11, 12]
    assert total_matches(skewed).first()["total"] == 6000


def test_only_heavy_keys_of_a_large_table_are_copied(spark, monkeypatch):
    """The rows are those of a plain join, null and missing keys too; a table as large as the rows goes over once but for its heavy keys."""
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    left = spark.range(400).selectExpr("CASE WHEN id < 100 THEN 1 WHEN id < 110 THEN NULL WHEN id % 2 = 0 THEN id END AS k", "id", "string(id % 3) AS t")
    table = spark.range(1, 300).selectExpr("id AS k", "id * 2 AS v")
    got = skew.lookup_large(left, table, ["k"])
    assert rows(got) == rows(left.join(table, "k", "left").select("k", "id", "t", "v"))
    copied = []
    monkeypatch.setattr(skew, "SPREAD", 5)
    plain = type(table).join
    monkeypatch.setattr(type(table), "join", lambda a, b, *rest: copied.append(b.count()) or plain(a, b, *rest))
    skew.lookup_large(left, table, ["k"])
    assert copied[-1] == 299 + 4


def test_incident_edges_copy_hot_nodes_only(spark):
    """Before, every node was repeated for the join."""
    nodes = spark.range(50).selectExpr("1L AS case_id", "string(id) AS node_id", "'Host' AS node_type", "string(id) AS node_label")
    edges = spark.range(50).selectExpr("1L AS case_id", "string(id) AS edge_id", "'E' AS edge_type", "string(id) AS src_id", "'0' AS dst_id", "timestamp_seconds(id) AS timestamp", "map('a', 'b') AS properties")
    found = graph.incident_edges(nodes, edges)
    assert "__heavy" in found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 100


def test_dealt_rows_are_sorted_in_parts(spark, skewed):
    """Before, a task sorted all rows of its input; the first rows of the groups are the same."""
    order = [F.col("t"), F.col("id")]
    dealt = top_per_group(skewed, ["key"], order, 3, "n", dealt=True)
    assert "RebalancePartitions" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert rows(dealt) == rows(top_per_group(skewed, ["key"], order, 3, "n"))

"""Tables that change all at once: replacement, empty re-parse, readers and writers at the same time, lost writers."""

import pytest
from pyspark.sql import functions as F

from casewise.sources import versions
from conftest import rows


def evidence(spark, *numbers, say="a", n=2):
    made = spark.createDataFrame([(1 + e % 2, e) for e in numbers], "case_id long, evidence_id long")
    return made.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(
        "*", F.concat(F.lit(say), "k").alias("description"), F.timestamp_seconds("k").alias("timestamp")
    )


def stored(spark, path, number=None):
    return rows(versions.read(spark, path, "events", number), "evidence_id", "description")


def test_evidence_is_replaced_and_goes_when_it_gives_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.latest(spark, path) == 0
    with pytest.raises(ValueError):
        versions.read(spark, path, "events")
    assert versions.commit_events(evidence(spark, 1, 2, 3), path) == 1
    parsed = evidence(spark, 2, 3, 9)
    assert versions.commit_events(evidence(spark, 2, say="b", n=1), path, parsed) == 2
    assert stored(spark, path) == [(1, "a1"), (1, "a2"), (2, "b1")]
    assert stored(spark, path, 1) == [(e, f"a{k}") for e in (1, 2, 3) for k in (1, 2)]
    versions.commit_events(evidence(spark, 1).limit(0), path, evidence(spark, 1, 2))
    assert stored(spark, path) == [] and versions.read(spark, path, "events").columns == evidence(spark, 1).columns
    versions.commit_events(evidence(spark, 4, n=1), path)
    assert stored(spark, path) == [(4, "a1")]


def test_a_reader_keeps_to_its_rows_and_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit_events(evidence(spark, 1, 2), path)
    reader = versions.read(spark, path, "events")
    versions.commit_events(evidence(spark, 1, say="new"), path)
    assert rows(reader, "evidence_id", "description") == [(1, "a1"), (1, "a2"), (2, "a1"), (2, "a2")]

    def lost(*_):
        raise RuntimeError("lost")

    before = stored(spark, path)
    monkeypatch.setattr(versions, "_put_in_place", lost)
    with pytest.raises(RuntimeError, match="lost"):
        versions.commit_events(evidence(spark, 1, 2, 3, say="never"), path)
    assert stored(spark, path) == before and versions.latest(spark, path) == 2


def test_writers_at_the_same_time_keep_each_others_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit_events(evidence(spark, 1, 2), path)
    place, others = versions._put_in_place, [evidence(spark, 2, say="other", n=1), evidence(spark, 3, say="other", n=1)]

    def slow(*names):
        if others:
            other = others.pop()
            versions.commit_events(other, path)
        return place(*names)

    monkeypatch.setattr(versions, "_put_in_place", slow)
    versions.commit_events(evidence(spark, 1, say="mine", n=1), path)
    assert stored(spark, path) == [(1, "mine1"), (2, "other1"), (3, "other1")]
    assert versions.latest(spark, path) == 4


def test_parts_change_together_and_compact_keeps_the_live_rows(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([(c, f"n{k}") for c in (1, 2) for k in range(3)], "case_id long, node_label string").withColumn("node_type", F.lit("User"))
    edges = nodes.select("case_id", F.col("node_label").alias("src"), F.lit("RAN").alias("edge_type"))
    metadata = nodes.groupBy("case_id").agg(F.count("*").alias("node_count"))
    versions.commit_graph(nodes, edges, metadata, path)
    # Case 2 now has nodes alone, case 1 nothing.
    versions.commit_graph(nodes.where("case_id = 2 AND node_label = 'n1'"), edges.limit(0), metadata.limit(0), path, nodes)
    want = {"nodes": [(2,)], "edges": [], "metadata": []}
    assert {p: rows(versions.read(spark, path, p), "case_id") for p in want} == want
    number = versions.compact(spark, path, versions.GRAPH)
    assert {p: rows(versions.read(spark, path, p), "case_id") for p in want} == want
    assert versions._children(spark, f"{path}/live") == [str(number)]
    assert len(versions._children(spark, f"{path}/data/nodes")) == 1


def test_rows_are_written_where_they_are(spark, tmp_path):
    """No shuffle for the layout: a sorted file for every task, compressed for hexadecimal ids."""
    path = str(tmp_path / "events")
    frame = spark.range(0, 300, 1, 3).selectExpr("id % 5 AS case_id", "id % 7 AS evidence_id", "timestamp_seconds(300 - id) AS timestamp", "sha2(string(id), 256) AS event_uid")
    versions.commit_events(frame, path)
    files = sorted((tmp_path / "events" / "data" / "events").rglob("*.parquet"))
    assert len(files) == 3 and all(f.name.endswith(".zstd.parquet") for f in files)
    for file in files:
        keys = [(r.case_id, r.evidence_id, r.timestamp) for r in spark.read.parquet(str(file)).collect()]
        assert keys == sorted(keys)
    assert rows(versions.read(spark, path, "events")) == rows(frame)

"""Writers and streaming jobs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from casewise.operators.detect import windowed_brute_force
from casewise.operators.evidence import custody_entries
from casewise.sources import tables
from casewise.sources.files import Origin
from casewise.sources.line_logs import read_text_events, text_events
from casewise.streaming import jobs
from conftest import rows


def events(spark, tmp_path, name, lines, case, evidence):
    path = tmp_path / name
    path.write_text("\n".join(lines))
    return read_text_events(spark, str(path), Origin(case_id=case, evidence_id=evidence))


def test_event_table_replaces_only_its_evidence(spark, tmp_path):
    target = str(tmp_path / "events")
    first = events(spark, tmp_path, "a.txt", ["a", "b"], 1, 10).unionByName(events(spark, tmp_path, "b.txt", ["c"], 1, 11))
    tables.write_events(first, target)
    tables.write_events(events(spark, tmp_path, "c.txt", ["d"], 1, 10), target)
    stored = spark.read.parquet(target)
    assert rows(stored, "evidence_id", "description") == [(10, "d"), (11, "c")]
    assert tables.drop_case(spark, target, 1) and not tables.drop_case(spark, target, 1)


def test_append_tables(spark, tmp_path):
    log = custody_entries(events(spark, tmp_path, "a.txt", ["a", "b"], 1, 10), "PARSE", F.lit("2026-01-01"), 4)
    for _ in range(2):
        tables.append_custody(log, str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")).select("evidence_id", "user_id", F.col("details")["rows"])) == [(10, 4, "2")] * 2


def test_stream_ingest_matches_batch(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for n, text in enumerate(["one\ntwo\n", "three\n"]):
        folder = source / f"case_id={n}" / "evidence_id=5"
        folder.mkdir(parents=True)
        (folder / "a.log").write_text(text)

    def run():
        stream = jobs.line_stream(spark, str(source), "*.log")
        jobs.stream_ingest(stream, text_events, Origin(), target, str(tmp_path / "check")).awaitTermination(120)

    run()
    late = source / "case_id=0" / "evidence_id=6"
    late.mkdir()
    (late / "b.log").write_text("four\n")
    run()
    run()
    want = read_text_events(spark, str(source), Origin())
    names = ["case_id", "evidence_id", "event_uid", "description"]
    assert rows(spark.read.parquet(target), *names) == rows(want, *names)
    assert spark.read.parquet(target).count() == 4


def test_windowed_stream_matches_batch(spark, tmp_path):
    start = datetime(2026, 3, 1, 10)
    data = [(1, "u", "Failed Logon", start + timedelta(minutes=m)) for m in (0, 1, 2, 3, 4, 12, 13, 200)]
    batch = spark.createDataFrame(data, "case_id long, user string, event_type string, timestamp timestamp")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        jobs.windowed_brute_force_stream(stream, threshold=2).writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(windowed_brute_force(batch, threshold=2))


def test_dedupe_stream(spark, tmp_path):
    schema = "evidence_id long, case_id long, sha256 string"
    target, source = str(tmp_path / "stored"), tmp_path / "in"

    def feed(number, data):
        spark.createDataFrame(data, schema).repartition(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.dedupe_stream(stream, target, str(tmp_path / "check")).awaitTermination(120)

    feed(0, [(1, 1, "a"), (2, 1, "a"), (3, 2, "a")])
    feed(1, [(4, 1, "a"), (5, 1, "b"), (6, 1, "b")])
    assert rows(spark.read.parquet(target), "evidence_id") == [(1,), (3,), (5,)]


def test_graph_and_validation_tables(spark, tmp_path):
    from casewise.operators import graph, validate
    from test_graph import normalized

    nodes, edges = graph.build_graph(normalized(spark, {"hostname": "h", "username": "u"}))
    folder = str(tmp_path / "graph")
    for _ in range(2):
        tables.write_graph(nodes, edges, graph.graph_metadata(nodes, edges), folder)
    assert spark.read.parquet(f"{folder}/nodes").count() == 4
    assert spark.read.parquet(f"{folder}/metadata").first()["edge_count"] == 1
    found = validate.failures(nodes, edges)
    summary = validate.validation_summary(nodes, found)
    tables.write_validation(summary, validate.validation_records(found, summary), folder)
    assert spark.read.parquet(f"{folder}/results").first()["validation_status"] == "PASSED"


def test_rows_go_when_their_evidence_gives_none(spark, tmp_path):
    from pyspark.sql import functions as F

    from casewise.sources import tables

    path = str(tmp_path / "events")
    rows = spark.range(100).select((F.col("id") % 3).alias("case_id"), (F.col("id") % 12).alias("evidence_id"), "id", F.current_timestamp().alias("timestamp"))
    read = lambda: {r.id for r in spark.read.parquet(path).collect()}
    tables.write_events(rows, path, rows)
    assert read() == set(range(100))
    # Evidence 4 is parsed to nothing, 5 to one row, the others are not read at all.
    parsed = rows.where("evidence_id IN (4, 5)")
    tables.write_events(rows.where("id = 5"), path, parsed)
    assert read() == {k for k in range(100) if k % 12 not in (4, 5)} | {5}
    tables.write_events(rows.limit(0), path, rows)
    assert not [p for p in (tmp_path / "events").rglob("*.parquet")]

"""Named queries that write rows of the test tables as files, read them with the public readers, and their SQL.

The files lie in the shared folder as ``case_id=.../evidence_id=.../``. Positions within a file
depend on how it was written, so ``seq`` and the uid made from it are left out.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators import graph, validate
from casewise.operators.skew import spread_rows
from casewise.plans import adapters as A
from casewise.plans import oracle as O
from casewise.plans.queries import EVENT_TEXT, ORIGIN, YEAR, _order_rows, _stored_graph, _validated, _xml_pieces, query
from casewise.session import materialize, scratch_path
from casewise.sources import archive, csv_files, ingest, json_files, line_logs, tables, versions, winevent_xml, xml_files
from casewise.streaming import jobs

READ = [c for c in EVENT_TEXT if c not in ("event_uid", "seq")]
LAYOUT = ["case_id", "evidence_id"]
OWN_PATTERN = "part-*.txt"
# Rows of a JSON or XML document.
DOCUMENT_ROWS = 500
ARCHIVES_A_TASK = 50_000
FOLDERS_A_WRITE = 50_000
# Which kind of JSON file an order goes to: 0 an array, 1 a file of its own, 2 a line.
_JSON_KIND = "CASE WHEN seq % 100 = 1 THEN 1 WHEN seq % 2 = 1 THEN 0 ELSE 2 END"


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("case_id", F.col("seq") % 3).withColumn("evidence_id", F.col("seq") % 16)


def _write_text(rows: DataFrame, name: str) -> str:
    """Write the column ``line`` with the layout as text files; returns the folder. Readers called by name take them whatever their suffix."""
    folder = scratch_path(rows.sparkSession, name)
    rows.select(*LAYOUT, "line").write.partitionBy(*LAYOUT).text(folder)
    return folder


def _read(events: DataFrame) -> DataFrame:
    """The compared columns; a description that is the record itself is not compared letter by letter."""
    text = F.col("description")
    return events.withColumn("description", F.when(text.startswith("{"), "record").otherwise(text)).select(*READ)


def _named(names: list[str]) -> list:
    columns = ["time_text", "host", "user", "event_type", "event_id", "severity", "description", "source"]
    return [F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]


NAMES_A = ["Timestamp", "Hostname", "USER", "action", "ID", "Level", "Message", "src_ip"]
NAMES_B = ["date", "computer", "account", "event_type", "event_id", "severity", "description", "ip"]
JSON_NAMES = ["Timestamp", "HOST", "UserName", "Type", "ID", "Level", "Message", "src_ip"]


@query
def csv_file_read(spark, d):
    """CSV files with two kinds of header in one folder."""
    rows = _placed(_order_rows(spark, d))
    folder = scratch_path(spark, "csv")
    for part, names in ((0, NAMES_A), (1, NAMES_B)):
        some = rows.where(F.col("evidence_id") % 2 == part).select(*LAYOUT, *_named(names))
        some.write.mode("append").option("header", True).partitionBy(*LAYOUT).csv(folder)
    return _read(csv_files.read_mixed_csv_events(spark, folder, ORIGIN))


@query
def csv_wide_read(spark, d):
    rows = A.table(spark, d, "orders").select(
        (F.col("o_orderkey") % 3).alias("case_id"),
        (F.col("o_orderkey") % 16).alias("evidence_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("log_time"),
        F.concat(F.lit("u"), F.col("o_custkey")).alias("Account"),
        F.lit("m").alias("Machine"),
        F.col("o_orderpriority").alias("remote_ip"),
        F.col("o_orderstatus").alias("Category"),
        F.col("o_orderkey").alias("number"),
    )
    folder = scratch_path(spark, "csv")
    rows.write.option("header", True).partitionBy(*LAYOUT).csv(folder)
    return csv_files.read_mixed_csv_events(spark, folder, ORIGIN, "wide").select(*READ)


def _json_folder(spark, d, names: list[str]) -> str:
    """All orders in documents of three kinds: arrays, single objects (every hundredth), and one object per line."""
    record = F.to_json(F.struct(*_named(names)))
    rows = _order_rows(spark, d).select("seq", record.alias("record"), F.expr(_JSON_KIND).alias("kind"))
    block = F.when(F.col("kind") == 1, F.col("seq")).otherwise(F.expr(f"seq div {DOCUMENT_ROWS}"))
    grouped = rows.where("kind != 2").groupBy("kind", block.alias("evidence_id"))
    whole = grouped.agg(F.sort_array(F.collect_list("record")).alias("records")).select(
        F.col("kind").alias("case_id"),
        "evidence_id",
        F.when(F.col("kind") == 0, F.concat(F.lit("["), F.array_join("records", ", "), F.lit("]"))).otherwise(F.col("records")[0]).alias("line"),
    )
    lines = rows.where("kind = 2").select(F.col("kind").alias("case_id"), (F.col("seq") % 8).alias("evidence_id"), F.col("record").alias("line"))
    files = materialize(whole.unionByName(lines), "json-files")
    # The names of all folders that a write has made come to the driver together.
    writes = max(1, -(-files.where("case_id <> 2").count() // FOLDERS_A_WRITE))
    folder = scratch_path(spark, "json")
    for k in range(writes):
        some = files.where(F.pmod(F.xxhash64(*LAYOUT), F.lit(writes)) == k)
        some.write.mode("append").partitionBy(*LAYOUT).text(folder)
    return folder


@query
def json_file_read(spark, d):
    """JSON files of every layout, told apart by the reader."""
    return _read(json_files.read_json_events(spark, _json_folder(spark, d, JSON_NAMES), ORIGIN))


@query
def json_wide_read(spark, d):
    names = ["Timestamp", "HOST", "UserName", "Action", "number", "Severity", "Message", "src_ip"]
    return _read(json_files.read_json_events(spark, _json_folder(spark, d, names), ORIGIN, profile="wide"))


@query
def text_file_read(spark, d):
    line = F.concat(F.lit("  order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_custkey"), F.repeat(F.lit(" x"), F.col("o_orderkey").cast("int") % 400), F.lit(" \t"))
    rows = A.table(spark, d, "orders").select(
        (F.col("o_orderkey") % 3).alias("case_id"), (F.col("o_orderkey") % 16).alias("evidence_id"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("   ")).otherwise(line).alias("line"),
    )
    return line_logs.read_text_events(spark, _write_text(rows, "text"), ORIGIN).select(*READ)


@query
def winevent_file_read(spark, d):
    """Windows event XML files and a file without any event block, whose lines are events."""
    blocks = _xml_pieces(spark, d).select("case_id", "evidence_id", F.concat("line", F.lit("</Event>")).alias("line"))
    plain = A.table(spark, d, "nation").select(F.lit(99).alias("case_id"), F.lit(1).alias("evidence_id"), F.concat(F.lit("nation "), F.col("n_name")).alias("line"))
    return winevent_xml.read_winevent_xml(spark, _write_text(blocks.unionByName(plain), "winevent"), ORIGIN).select(*READ)


def _xml_documents(spark, d) -> DataFrame:
    """XML documents of ``DOCUMENT_ROWS`` orders each."""
    row = F.concat(
        F.lit("<order><Time>"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("</Time><User>u"), F.col("o_custkey"),
        F.lit("</User><Computer>"), F.col("o_orderpriority"), F.lit("</Computer><Severity>high</Severity></order>"),
    )
    grouped = A.table(spark, d, "orders").groupBy(F.expr(f"o_orderkey div {DOCUMENT_ROWS}").alias("evidence_id"))
    return grouped.agg(F.concat_ws("", F.sort_array(F.collect_list(row))).alias("rows")).select(
        F.lit(1).alias("case_id"), "evidence_id", F.concat(F.lit("<orders>"), F.col("rows"), F.lit("</orders>")).alias("line")
    )


@query
def xml_file_read(spark, d):
    return xml_files.read_xml_events(spark, _write_text(_xml_documents(spark, d), "xml"), ORIGIN).select(*READ)


@query
def xml_flat_read(spark, d):
    return xml_files.read_xml_events(spark, _write_text(_xml_documents(spark, d), "xml"), ORIGIN, "flat").select(*READ)


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An archive per row: a text, a JSON and a CSV member, and one that is not read."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as target:
                target.writestr("notes.txt", f"customer {row.number}\nof segment {row.segment}\n")
                target.writestr("deep/a.json", json.dumps([{"message": f"json {row.number}", "host": row.segment}]))
                target.writestr("b.csv", f"message,user\ncsv {row.number},u{row.number}\n")
                target.writestr("tool.exe", "MZ")
            out.append((row.number % 4, row.number, f"zip/{row.number}", buffer.getvalue()))
        yield pd.DataFrame(out, columns=["case_id", "evidence_id", "path", "content"])


def _archives(spark, d) -> DataFrame:
    """An archive for every customer, made by as many tasks as there are cores or more."""
    customers = A.table(spark, d, "customer").select(F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("segment"))
    return spread_rows(customers, ARCHIVES_A_TASK).mapInPandas(_zipped, "case_id long, evidence_id long, path string, content binary")


@query
def archive_read(spark, d):
    """ZIP archives held as rows; members go to the readers of their kind."""
    records = materialize(archive.explode_archives(_archives(spark, d)), "members")
    return archive.archive_events(records, ORIGIN, YEAR).select(*READ)


@query
def archive_skipped(spark, d):
    """What archives hold and is not read, with the reason."""
    return archive.skipped_members(archive.explode_archives(_archives(spark, d)))


@query
def stored_events(spark, d):
    """The events table after writing it twice, the second time the even evidence only; every sixth file now gives no event."""
    folder = scratch_path(spark, "events")
    events = A.case_events(spark, d)
    tables.write_events(events, folder)
    again = events.where("evidence_id % 2 = 0")
    tables.write_events(again.where("evidence_id % 6 <> 0").withColumn("host", F.upper("host")), folder, again)
    return spark.read.schema(events.schema).parquet(folder).select(*EVENT_TEXT)


@query
def versioned_events(spark, d):
    """As ``stored_events``, in a table that changes all at once: the rows of the list before, and those after it."""
    path = scratch_path(spark, "versioned-events")
    events = A.case_events(spark, d)
    first = versions.commit_events(events, path)
    again = events.where("evidence_id % 2 = 0")
    versions.commit_events(again.where("evidence_id % 6 <> 0").withColumn("host", F.upper("host")), path, again)
    before = versions.read(spark, path, "events", first).select(F.lit("before").alias("state"), *EVENT_TEXT)
    return before.unionByName(versions.read(spark, path, "events").select(F.lit("after").alias("state"), *EVENT_TEXT))


@query
def versioned_graph(spark, d):
    """Nodes, edges and metadata of all cases in a versioned table, written again without case 3 and compacted."""
    path = scratch_path(spark, "versioned-graph")
    built = _stored_graph(spark, d)
    parts = (*built, graph.graph_metadata(*built))
    versions.commit_graph(*parts, path)
    versions.commit_graph(*[df.where("case_id <> 3") for df in parts], path, parts[0])
    versions.compact(spark, path, versions.GRAPH)
    return _export_rows(*[versions.read(spark, path, part) for part in ("nodes", "edges", "metadata")])


@query
def stored_graph(spark, d):
    """Counts by type of the stored graph of all cases, written again without case 3."""
    folder = scratch_path(spark, "graph")
    nodes, edges = _stored_graph(spark, d)
    metadata = graph.graph_metadata(nodes, edges)
    tables.write_graph(nodes, edges, metadata, folder)
    rest = [df.where("case_id <> 3") for df in (nodes, edges, metadata)]
    tables.write_graph(*rest, folder, nodes.select("case_id"))
    parts = [
        spark.read.parquet(f"{folder}/{part}").groupBy("case_id", F.lit(part).alias("part"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("rows"))
        for part, kind in (("nodes", "node_type"), ("edges", "edge_type"))
    ]
    return parts[0].unionByName(parts[1]).withColumn("case_id", F.col("case_id").cast("long"))


@query
def stored_validation(spark, d):
    """Validation results appended twice: two rows per case and failure."""
    folder = scratch_path(spark, "validation")
    nodes, found = _validated(spark, d)
    summary = validate.validation_summary(nodes, found)
    for _ in range(2):
        tables.write_validation(summary, validate.validation_records(found, summary), folder)
    results = spark.read.parquet(f"{folder}/results").groupBy("case_id").agg(F.count(F.lit(1)).alias("results"))
    records = spark.read.parquet(f"{folder}/records").groupBy("case_id").agg(F.count(F.lit(1)).alias("records"))
    return results.join(records, "case_id", "left").select("case_id", "results", F.coalesce("records", F.lit(0)).alias("records"))


@query
def graph_export(spark, d):
    """Nodes, edges and counts of the export of one case."""
    return _export_rows(*graph.graph_export(*graph.build_graph(A.normalized_events(spark, d)), 3))


def _export_rows(nodes, edges, metadata) -> DataFrame:
    """Nodes, edges by type and ends, and metadata of graphs as rows of one form."""

    def part(df, name, number, kind, label):
        return df.select("case_id", F.lit(name).alias("part"), number.alias("number"), kind.alias("kind"), label.alias("label"))

    ends = F.concat_ws(" > ", "src_label", "dst_label")
    return (
        part(nodes, "node", F.lit(1).cast("long"), F.col("node_type"), F.col("node_label"))
        .unionByName(part(edges.groupBy("case_id", "edge_type", ends.alias("ends")).count(), "edge", F.col("count"), F.col("edge_type"), F.col("ends")))
        .unionByName(part(metadata, "nodes", F.col("node_count").cast("long"), F.lit("all"), F.lit("")))
        .unionByName(part(metadata, "edges", F.col("edge_count").cast("long"), F.lit("all"), F.lit("")))
    )


@query
def stream_text(spark, d):
    """Text files taken in as a stream until none is left."""
    rows = A.table(spark, d, "orders").select(
        (F.col("o_orderkey") % 3).alias("case_id"), (F.col("o_orderkey") % 16).alias("evidence_id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("line")
    )
    target = scratch_path(spark, "streamed")
    lines = jobs.line_stream(spark, _write_text(rows, "text"))
    jobs.stream_ingest(lines, line_logs.text_events, ORIGIN, target, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).withColumn("case_id", F.col("case_id").cast("long")).select(*READ)


@query
def stream_duplicates(spark, d):
    """Evidence files taken in as a stream; the first of each hash in a case is stored."""
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "stored")
    files = A.evidence_files(spark, d).select("evidence_id", "case_id", "sha256", "size")
    files.write.parquet(source)
    arriving = spark.readStream.schema(files.schema).parquet(source)
    jobs.dedupe_stream(arriving, target, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).select("evidence_id", "case_id", "sha256", "size")


@query
def stream_windows(spark, d):
    """Windows of failed logons counted on a stream; a last event, years later, closes them all."""
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "windows")
    events = A.case_events(spark, d).select("case_id", "event_type", "timestamp")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("case_id"), F.lit("Failed Logon").alias("event_type"), F.lit("2100-01-01").cast("timestamp").alias("timestamp"))
    events.unionByName(last).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    windows = jobs.windowed_brute_force_stream(stream, threshold=2, by=("case_id",))
    writer = windows.writeStream.outputMode("append").format("parquet").option("path", target)
    writer.option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


@query
def own_reader(spark, d):
    """Files of a kind that the library does not know, through a reader registered for them."""
    rows = A.table(spark, d, "orders").select(
        (F.col("o_orderkey") % 3).alias("case_id"), (F.col("o_orderkey") % 16).alias("evidence_id"), F.concat(F.lit("own "), F.col("o_orderkey")).alias("line")
    )
    folder = _write_text(rows, "own")
    ingest.register_reader(OWN_PATTERN, lambda s, path, origin, year: line_logs.read_text_events(s, path, origin, OWN_PATTERN))
    try:
        return ingest.read_evidence(spark, folder, ORIGIN, YEAR, [OWN_PATTERN]).select(*READ)
    finally:
        ingest.READERS.pop(OWN_PATTERN)


@query
def own_constraint(spark, d):
    """A caller's rule: addresses with three edges or more."""
    nodes, edges = graph.build_graph(A.normalized_events(spark, d))
    rule = validate.ConstraintRule(
        name="Busy address",
        category="Network",
        description="An address has fewer than three edges.",
        severity="low",
        node_type="IP_Address",
        edge_types=None,
        measures={"edges_seen": F.count(F.lit(1))},
        broken=F.col("edges_seen") >= 3,
        reason=F.concat(F.col("node_label"), F.lit(" has "), F.col("edges_seen"), F.lit(" edges")),
        suggestion="Look at it.",
    )
    return validate.failures(nodes, edges, [rule]).select("case_id", "node_id", "rule_name", "status", "violation_reason", "resolution_details")


# ---- SQL ---------------------------------------------------------------------------------

_PLACE = "seq % 3 AS case_id, seq % 16 AS evidence_id"


def _rows_sql(case: str = _PLACE, **parts: str) -> str:
    shape = {"source": "'JsonLog'", "ip": "nullif(source0, '')", "description": "coalesce(description0, 'record')"} | parts
    return f"SELECT * EXCLUDE (event_uid, seq, case_id, evidence_id), {case} FROM ({O._UNIVERSAL.format(**shape)})"


O._add("csv_file_read", [O._ROWS], _rows_sql(source="'CSVFile'", event_type="coalesce(nullif(event_type0, ''), 'CSVRecord')"))

_PLAIN = """SELECT o_orderkey % 3 AS case_id, o_orderkey % 16 AS evidence_id, {time} AS "timestamp", {inferred} AS ts_inferred, {source} AS source,
    {event_type} AS event_type, CAST(NULL AS VARCHAR) AS event_id, {user} AS "user", {host} AS host, {ip} AS ip_address,
    CAST(NULL AS VARCHAR) AS process, CAST(NULL AS VARCHAR) AS file_path, {severity} AS severity, {description} AS description,
    {severity} IN ('high', 'critical') AS is_suspicious, CASE {severity} WHEN 'high' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS confidence_score
    FROM orders"""
_LINE = {
    "time": "TIMESTAMP '2024-02-01 00:00:00'", "inferred": "TRUE", "source": "'TextLog'", "event_type": "'LogLine'", "user": "'UNKNOWN_USER'",
    "host": "'UNKNOWN_HOST'", "ip": "CAST(NULL AS VARCHAR)", "severity": "'low'",
}
_SECOND = "date_trunc('second', o_orderdate::TIMESTAMP)"
_AT = f"strftime({_SECOND}, '%Y-%m-%d %H:%M:%S')"
O._add(
    "csv_wide_read",
    [],
    _PLAIN.format(
        time=_SECOND, inferred="FALSE", source="'CSV Log'", event_type="o_orderstatus", user="'u' || o_custkey", host="'m'", ip="o_orderpriority",
        severity="'low'",
        description=f"'log_time=' || {_AT} || ' | account=u' || o_custkey || ' | machine=m | remote_ip=' || o_orderpriority || ' | category=' || o_orderstatus",
    ),
)
_DOCUMENT_PLACE = f"{_JSON_KIND} AS case_id, CASE {_JSON_KIND} WHEN 0 THEN seq // {DOCUMENT_ROWS} WHEN 1 THEN seq ELSE seq % 8 END AS evidence_id"
O._add("json_file_read", [O._ROWS], _rows_sql(_DOCUMENT_PLACE, event_type="coalesce(nullif(event_type0, ''), 'JsonLog')"))
O._add(
    "json_wide_read",
    [O._ROWS],
    _rows_sql(_DOCUMENT_PLACE, source="'JSON Log'", event_type="coalesce(nullif(event_type0, ''), 'JSON Event')").replace(
        "nullif(event_id0, '') AS event_id", "CAST(NULL AS VARCHAR) AS event_id"
    ),
)
O._add(
    "text_file_read",
    [],
    _PLAIN.format(**_LINE, description="'order ' || o_orderkey || ' of ' || o_custkey || repeat(' x', CAST(o_orderkey % 400 AS INTEGER))") + " WHERE o_orderkey % 9 <> 0",
)
O._add(
    "winevent_file_read",
    [],
    f"""SELECT * EXCLUDE (event_uid, seq) FROM ({O.ORACLE["winevent_roundtrip"]}) UNION ALL BY NAME
      SELECT 99 AS case_id, 1 AS evidence_id, TIMESTAMP '2024-02-01 00:00:00' AS "timestamp", TRUE AS ts_inferred, 'WindowsEVTX' AS source,
      'WindowsLog' AS event_type, 'UNKNOWN_USER' AS "user", 'UNKNOWN_HOST' AS host, 'low' AS severity, 'nation ' || n_name AS description,
      FALSE AS is_suspicious, 0.2::DOUBLE AS confidence_score FROM nation""",
)
_XML_PLACE = ("o_orderkey % 3 AS case_id, o_orderkey % 16 AS evidence_id", f"CAST(1 AS BIGINT) AS case_id, o_orderkey // {DOCUMENT_ROWS} AS evidence_id")
O._add("xml_file_read", [], _PLAIN.format(**_LINE | {"source": "'XmlLog'", "event_type": "'order'"}, description="'XML node <order> parsed'").replace(*_XML_PLACE))
O._add(
    "xml_flat_read",
    [],
    _PLAIN.format(
        time=_SECOND, inferred="FALSE", source="'XML Log'", event_type="'order'", user="'u' || o_custkey", host="o_orderpriority",
        ip="CAST(NULL AS VARCHAR)", severity="'high'", description="'XML element order'",
    ).replace(*_XML_PLACE),
)
_MEMBERS = """(VALUES ('TextLog', 'LogLine', 1), ('TextLog', 'LogLine', 2), ('JsonLog', 'JsonLog', 3), ('CSVFile', 'CSVRecord', 4)) m(source, event_type, k)"""
O._add(
    "archive_read",
    [],
    f"""SELECT c_custkey % 4 AS case_id, c_custkey AS evidence_id, TIMESTAMP '2024-02-01 00:00:00' AS "timestamp", TRUE AS ts_inferred, source, event_type,
      CAST(NULL AS VARCHAR) AS event_id, CASE k WHEN 4 THEN 'u' || c_custkey ELSE 'UNKNOWN_USER' END AS "user",
      CASE k WHEN 3 THEN c_mktsegment ELSE 'UNKNOWN_HOST' END AS host, CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS process,
      CAST(NULL AS VARCHAR) AS file_path, 'low' AS severity, CASE k WHEN 1 THEN 'customer ' || c_custkey WHEN 2 THEN 'of segment ' || c_mktsegment
      WHEN 3 THEN 'json ' || c_custkey ELSE 'csv ' || c_custkey END AS description, FALSE AS is_suspicious, 0.2::DOUBLE AS confidence_score
      FROM customer, {_MEMBERS}""",
)
O._add(
    "archive_skipped",
    [],
    """SELECT c_custkey % 4 AS case_id, c_custkey AS evidence_id, 'zip/' || c_custkey AS path, 'tool.exe' AS member,
      'not read inside archives' AS reason FROM customer""",
)
O._add(
    "stored_events",
    [O._EV],
    f"""SELECT {", ".join('CASE WHEN evidence_id % 2 = 0 THEN upper(host) ELSE host END AS host' if c == "host" else f'"{c}"' for c in EVENT_TEXT)} FROM evs WHERE evidence_id % 6 <> 0""",
)
_UPPER_EVEN = ", ".join('CASE WHEN evidence_id % 2 = 0 THEN upper(host) ELSE host END AS host' if c == "host" else f'"{c}"' for c in EVENT_TEXT)
O._add(
    "versioned_events",
    [O._EV],
    f"""SELECT 'before' AS state, {", ".join(f'"{c}"' for c in EVENT_TEXT)} FROM evs
      UNION ALL SELECT 'after', {_UPPER_EVEN} FROM evs WHERE evidence_id % 6 <> 0""",
)
O._add(
    "stored_graph",
    O._GRAPH,
    """SELECT case_id, 'nodes' AS part, node_type AS kind, count(*) AS rows FROM nodes WHERE case_id <> 3 GROUP BY ALL
      UNION ALL SELECT case_id, 'edges', edge_type, count(*) FROM edges WHERE case_id <> 3 GROUP BY ALL""",
)
O._add(
    "stored_validation",
    O._CHECKED,
    """SELECT s.case_id, CAST(2 AS BIGINT) AS results, 2 * count(f.node_id) AS records FROM summary s LEFT JOIN failures f USING (case_id) GROUP BY ALL""",
)
# Rows of a graph's parts; the sign stands for the cases.
_EXPORT = """SELECT case_id, 'node' AS part, CAST(1 AS BIGINT) AS number, node_type AS kind, node_label AS label FROM nodes WHERE %
      UNION ALL SELECT case_id, 'edge', count(*), edge_type, concat_ws(' > ', src_label, dst_label) FROM edges WHERE % GROUP BY ALL
      UNION ALL SELECT case_id, 'nodes', count(*), 'all', '' FROM nodes WHERE % GROUP BY ALL
      UNION ALL SELECT case_id, 'edges', count(*), 'all', '' FROM edges WHERE % GROUP BY ALL"""
O._add(
    "graph_export",
    O._GRAPH,
    _EXPORT.replace("%", "case_id = 3"),
)
O._add("versioned_graph", O._GRAPH, _EXPORT.replace("%", "case_id <> 3"))
O._add("stream_text", [], _PLAIN.format(**_LINE, description="'order ' || o_orderkey"))
O._add("own_reader", [], _PLAIN.format(**_LINE, description="'own ' || o_orderkey"))
O.ORACLE["own_constraint"] = f"""SELECT case_id, node_id, 'Busy address' AS rule_name, 'VIOLATION' AS status,
    node_label || ' has ' || edge_count || ' edges' AS violation_reason, 'Look at it.' AS resolution_details
    FROM ({O.ORACLE["incident_counts"]}) WHERE node_type = 'IP_Address' AND edge_count >= 3"""
O.ORACLE["stream_windows"] = O.ORACLE["detect_windowed"]
O.ORACLE["stream_duplicates"] = O.ORACLE["evidence_dedupe"]

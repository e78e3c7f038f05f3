"""One named query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions import scoring, winevent
from casewise.functions.events import universal_event
from casewise.functions.timestamps import to_utc
from casewise.operators import components as components_op
from casewise.operators import correlate, detect, evidence, graph, inference, paths, ranking, report, search, timeline, validate
from casewise.plans import adapters as A
from casewise.schemas import FACT
from casewise.session import materialize
from casewise.sources import inventory, json_files, line_logs, winevent_xml
from casewise.sources.files import Origin

Query = Callable[[SparkSession, str], DataFrame]

ORIGIN = Origin(ingest_ts="2024-02-01 00:00:00")
YEAR = 2024
EVENT_TEXT = [
    "event_uid", "case_id", "evidence_id", "seq", "timestamp", "ts_inferred", "source", "event_type", "event_id",
    "user", "host", "ip_address", "process", "file_path", "severity", "description", "is_suspicious",
    "confidence_score",
]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- events and normalization -------------------------------------------------------


@query
def normalize_counts(spark, d):
    """Events per case, category, action and severity after normalization."""
    return (
        A.normalized_events(spark, d)
        .groupBy("case_id", "event_category", "action", "severity")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("timestamp_utc").alias("first_seen"),
            F.max("timestamp_utc").alias("last_seen"),
        )
    )


@query
def normalize_rows(spark, d):
    return A.normalized_events(spark, d).drop("raw_event_reference")


def _order_rows(spark, d):
    return A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.expr("o_orderkey % 64").alias("evidence_id"),
        F.col("o_orderkey").alias("seq"),
        F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Critical' WHEN 2 THEN 'weird' WHEN 3 THEN '' WHEN 4 THEN 'medium' END").alias("severity"),
        F.expr("CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('host-', o_custkey) END").alias("host"),
        F.expr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('u', o_custkey) END").alias("user"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE repeat('Type_', cast(o_orderkey % 30 AS int)) END").alias("event_type"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE repeat('7', cast(o_orderkey % 70 AS int)) END").alias("event_id"),
        F.expr("CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE concat('Order ', o_orderstatus) END").alias("description"),
        F.expr("CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('src', o_orderpriority) END").alias("source"),
        F.expr("CASE WHEN o_orderkey % 10 = 0 THEN 'not a date' WHEN o_orderkey % 10 = 1 THEN NULL WHEN o_orderkey % 10 = 2 "
               "THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:20:30Z') WHEN o_orderkey % 10 = 3 "
               "THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 10:20:30.250+02:00') "
               "ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END").alias("time_text"),
    )


@query
def universal_events(spark, d):
    """Defaults, cuts, severity clamp and confidence of the universal record."""
    names = ["severity", "host", "user", "event_type", "event_id", "description", "source"]
    fields = {n: F.col(n) for n in names}
    fields["timestamp"] = to_utc(F.col("time_text"), "iso", F.lit(None).cast("timestamp"))
    return universal_event(_order_rows(spark, d), fields, ORIGIN.ingest_time()).drop("raw_data")


@query
def json_roundtrip(spark, d):
    """Rows written as JSON lines with mixed-case names and read back through the alias table."""
    rows = _order_rows(spark, d)
    text = F.to_json(
        F.struct(
            F.col("time_text").alias("Timestamp"), F.col("host").alias("HOST"), F.col("user").alias("UserName"),
            F.col("event_type").alias("Type"), F.col("event_id").alias("ID"), F.col("severity").alias("Level"),
            F.col("description").alias("Message"), F.col("source").alias("src_ip"),
        )
    )
    line = F.when(F.col("seq") % 13 == 0, F.concat(text, F.lit(" trailing"))).otherwise(text)
    lines = rows.select("case_id", "evidence_id", "seq", line.alias("line"))
    events = json_files.json_events(json_files.line_records(lines), ORIGIN)
    # The text of the whole record stands in for a missing description; its layout is not compared.
    return events.drop("raw_data").withColumn(
        "description", F.when(F.col("description").startswith("{"), "record").otherwise(F.col("description"))
    )


@query
def syslog_roundtrip(spark, d):
    return line_logs.syslog_events(A.syslog_lines(spark, d), ORIGIN, YEAR).drop("raw_data")


@query
def syslog_descriptive(spark, d):
    return line_logs.syslog_events(A.syslog_lines(spark, d), ORIGIN, YEAR, "descriptive").drop("raw_data")


def _xml_pieces(spark, d):
    events = A.case_events(spark, d)
    raw = F.col("raw_data")

    def data(name, value):
        return F.concat(F.lit(f'<Data Name="{name}">'), F.coalesce(value, F.lit("")), F.lit("</Data>"))

    return events.select(
        "case_id",
        "evidence_id",
        "seq",
        F.concat(
            F.lit('<Events>\n<Event xmlns="urn:events"><System><Provider Name="Audit"/><EventID Qualifiers="0">'),
            F.coalesce("event_id", F.lit("")),
            F.lit("</EventID><Level>"),
            (F.col("seq") % 7).cast("string"),
            F.lit("</Level><Channel>Security</Channel><Computer>"),
            F.col("host"),
            F.lit('</Computer><TimeCreated SystemTime="'),
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.lit('Z"/></System><EventData>'),
            data("SubjectUserName", F.col("user")),
            F.when(F.col("seq") % 5 != 0, data("TargetUserName", F.concat(F.lit("target_"), F.col("host")))).otherwise(""),
            data("IpAddress", F.col("ip_address")),
            data("NewProcessName", F.col("process")),
            F.when(F.col("seq") % 11 == 0, F.lit("</Broken>")).otherwise("</EventData>"),
        ).alias("line"),
    )


@query
def winevent_roundtrip(spark, d):
    """Events written as Windows event XML and read back; broken blocks are skipped."""
    blocks = winevent_xml.event_blocks(_xml_pieces(spark, d))
    return winevent_xml.winevent_events(blocks, ORIGIN).drop("raw_data")


@query
def winevent_descriptive(spark, d):
    blocks = winevent_xml.event_blocks(_xml_pieces(spark, d))
    return winevent_xml.winevent_events(blocks, ORIGIN, "descriptive").drop("raw_data")


@query
def win_names(spark, d):
    return A.case_events(spark, d).select(
        "event_uid",
        winevent.event_name(F.col("event_id")).alias("event_name"),
        winevent.id_severity(F.col("event_id")).alias("id_severity"),
        winevent.level_severity((F.col("seq") % 7).cast("string")).alias("level_severity"),
    )


@query
def edge_weights(spark, d):
    """Edge weight per severity over a spread of confidences."""
    return A.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scoring.edge_weight(
            F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"),
            F.expr("CASE l_linenumber % 5 WHEN 0 THEN 0.9D WHEN 1 THEN 0.7D WHEN 2 THEN 0.2D WHEN 3 THEN NULL ELSE 0.0D END"),
        ).alias("weight"),
    )


@query
def heuristics(spark, d):
    """Privilege-gap heuristic between the supplier and the part of each line."""
    return A.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scoring.privilege_gap(
            F.col("l_suppkey").cast("string"),
            F.col("l_partkey").cast("string"),
            F.expr("CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 5 END"),
            F.expr("l_partkey % 6"),
        ).alias("gap"),
        scoring.zero_heuristic(F.lit("a"), F.lit("b"), F.lit(1), F.lit(9)).alias("zero"),
    )


# ---- evidence files --------------------------------------------------------------------


@query
def evidence_inventory(spark, d):
    return inventory.hash_records(A.table(spark, d, "pages"), "html", "page_id", "url")


@query
def evidence_gate(spark, d):
    gated = evidence.route_format(evidence.file_gate(A.evidence_files(spark, d)))
    return gated.select(
        "evidence_id", "clean_name", "extension", "reject_reason", "accepted", "format", "evidence_type"
    )


@query
def evidence_dedupe(spark, d):
    return evidence.dedupe_evidence(A.evidence_files(spark, d)).select("evidence_id", "case_id", "sha256", "size")


@query
def evidence_duplicates(spark, d):
    """Duplicate flags against stored hashes (those of even documents of the next source) and the batch."""
    files = A.evidence_files(spark, d)
    stored = files.where(F.col("is_deleted")).select(F.col("case_id"), "sha256")
    return evidence.mark_duplicates(files, stored).select("evidence_id", "case_id", "first_copy", "is_duplicate")


@query
def evidence_stages(spark, d):
    files = A.event_evidence(spark, d).withColumn("sha256", F.sha2("filename", 256))
    events = A.case_events(spark, d)
    normal = A.normalized_events(spark, d)
    nodes = graph.extract_nodes(normal)
    checked = search.live(A.cases(spark, d)).select("case_id")
    return evidence.stage_update(files, events, normal, nodes, checked).select(
        "evidence_id", "case_id", "processing_stage"
    )


@query
def custody_entries(spark, d):
    rows = evidence.custody_entries(A.case_events(spark, d), "PARSE", F.lit("2024-02-01 00:00:00"), 7)
    return rows.select("evidence_id", "user_id", "action", "timestamp", F.col("details")["rows"].alias("rows"))


@query
def custody_trail(spark, d):
    """Audit rows of all evidence, in time order within each file."""
    return ranking.number_rows(
        A.custody_log(spark, d).drop("details"), ["evidence_id"], [F.col("timestamp").asc(), F.col("log_id").asc()], "position"
    )


@query
def recent_activity(spark, d):
    return evidence.recent_activity(A.custody_log(spark, d)).withColumn("details", F.to_json("details"))


# ---- search ------------------------------------------------------------------------------


@query
def search_events(spark, d):
    return search.search_events(A.case_events(spark, d), severity="high", search="PASSWORD").select(*EVENT_TEXT)


@query
def search_normalized(spark, d):
    normal = A.normalized_events(spark, d).drop("raw_event_reference")
    return search.search_normalized(normal, category="Process Execution", search="ER")


@query
def search_cases(spark, d):
    return search.search_cases(A.cases(spark, d), investigator_id=3, status="open", search="segment b")


@query
def search_evidence(spark, d):
    return search.search_evidence(A.evidence_files(spark, d), file_type="log", search="a1").drop("original_filename")


@query
def suspicious_ranked(spark, d):
    return timeline.suspicious_ranked(A.case_events(spark, d)).select(*EVENT_TEXT)


@query
def active_alerts(spark, d):
    return search.active_alerts(A.case_events(spark, d)).select("event_uid", "case_id", "severity", "event_type")


@query
def timeline_keyword(spark, d):
    return search.timeline_keyword(A.case_events(spark, d), "Logon").select(*EVENT_TEXT)


@query
def case_title_search(spark, d):
    return search.case_title_search(A.cases(spark, d), "00012")


@query
def total_matches(spark, d):
    found = search.search_events(A.case_events(spark, d), search="10.0.1.")
    return ranking.total_matches(found, ["case_id"])


# ---- timeline ------------------------------------------------------------------------------


@query
def timeline_sequence(spark, d):
    return timeline.build_timeline(A.case_events(spark, d)).select("event_uid", "case_id", "timestamp", "sequence_id")


@query
def timeline_range(spark, d):
    events = A.case_events(spark, d)
    return timeline.timeline_range(events, "2024-01-05 00:00:00", "2024-01-20 12:00:00", "high").select(*EVENT_TEXT)


@query
def timeline_join(spark, d):
    """Events joined to their live evidence files."""
    joined = timeline.case_events(A.case_events(spark, d), A.event_evidence(spark, d), exclude_deleted=True)
    return joined.select("event_uid", "evidence_id", "case_id", "timestamp", "severity")


@query
def timeline_page(spark, d):
    return timeline.timeline_page(A.case_events(spark, d), case_id=3, skip=20, limit=100).select(
        "event_uid", "case_id", "timestamp", "event_type"
    )


@query
def owned_events(spark, d):
    """Events of the live cases of an investigator."""
    return timeline.owned(A.case_events(spark, d), A.cases(spark, d), 10).select("event_uid", "case_id")


@query
def reports_of_owner(spark, d):
    return timeline.reports_of_owner(A.reports(spark, d), A.cases(spark, d), 3)


@query
def dashboard_stats(spark, d):
    return report.dashboard_stats(A.cases(spark, d), A.evidence_files(spark, d), A.case_events(spark, d))


# ---- correlation and detection ---------------------------------------------------------------


@query
def correlate_events(spark, d):
    rows = correlate.correlate_events(A.case_events(spark, d))
    return rows.select("event_uid", "correlation_count", "is_suspicious", "confidence_score")


@query
def detect_alerts(spark, d):
    alerts = detect.detect(A.case_events(spark, d), detect.detection_rules(spark))
    return alerts.withColumn("events", F.array_join("events", ","))


@query
def detect_first_events(spark, d):
    return detect.first_events(A.case_events(spark, d), detect.detection_rules(spark))


@query
def detect_windowed(spark, d):
    """Ten-minute windows with at least two failed logons of a case."""
    return detect.windowed_brute_force(A.case_events(spark, d), threshold=2, by=("case_id",))


# ---- graph -------------------------------------------------------------------------------------


def _sorted_map(column: str):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";"
    )


NODE_NAMES = ["case_id", "node_id", "node_type", "node_label"]
EDGE_ENDS = ["case_id", "edge_type", "src_id", "dst_id"]
EDGE_CHECKS = ["case_id", "edge_id", "edge_type", "src_id", "dst_id", "timestamp", "properties"]


def _stored_graph(spark, d, node_columns=("*",), edge_columns=("*",)):
    """The graph as stored tables, of the columns that its queries read, for those that read it several times."""
    nodes, edges = graph.build_graph(A.normalized_events(spark, d))
    return materialize(nodes.select(*node_columns), "nodes"), materialize(edges.select(*edge_columns), "edges")


@query
def graph_nodes(spark, d):
    return graph.build_nodes(A.normalized_events(spark, d)).withColumn("properties", _sorted_map("properties"))


@query
def graph_edges(spark, d):
    return graph.extract_edges(A.normalized_events(spark, d)).withColumn("properties", _sorted_map("properties"))


@query
def graph_stats(spark, d):
    nodes, edges = graph.build_graph(A.normalized_events(spark, d))
    return graph.graph_metadata(nodes, edges, A.cases(spark, d))


@query
def nodes_of_type(spark, d):
    nodes = search.nodes_of_type(graph.build_nodes(A.normalized_events(spark, d)), "IP_Address")
    return nodes.withColumn("properties", _sorted_map("properties"))


@query
def edges_of_type(spark, d):
    edges = search.edges_of_type(graph.extract_edges(A.normalized_events(spark, d)), "COMMUNICATED_WITH")
    return edges.select("case_id", "edge_id", "src_label", "dst_label", "weight", "confidence", "timestamp")


@query
def node_search(spark, d):
    nodes = search.node_search(graph.build_nodes(A.normalized_events(spark, d)), "exe")
    return nodes.select("case_id", "node_id", "node_type", "node_label")


@query
def incident_edges(spark, d):
    nodes, edges = graph.build_graph(A.normalized_events(spark, d))
    return graph.incident_edges(nodes, edges).select("case_id", "node_id", "node_type", "node_label", "edge_id", "edge_type")


@query
def incident_counts(spark, d):
    nodes, edges = _stored_graph(spark, d, NODE_NAMES, EDGE_ENDS)
    return graph.incident_counts(nodes, edges)


@query
def connected_components(spark, d):
    nodes, edges = _stored_graph(spark, d, NODE_NAMES[:2], EDGE_ENDS)
    return components_op.connected_components(nodes, edges, leaf_edges="BELONGS_TO")


@query
def component_counts(spark, d):
    nodes, edges = _stored_graph(spark, d, NODE_NAMES[:2], EDGE_ENDS)
    return graph.component_counts(components_op.connected_components(nodes, edges, leaf_edges="BELONGS_TO"))


# ---- paths ---------------------------------------------------------------------------------------


def _path_requests(nodes):
    """From the first address of each case to every other address of the case."""
    addresses = nodes.where(F.col("node_type") == "IP_Address")
    first = addresses.groupBy("case_id").agg(F.min("node_label").alias("start_node"))
    return addresses.join(first, "case_id").select(
        F.concat_ws(">", F.col("case_id").cast("string"), "node_label").alias("request_id"),
        "case_id",
        "start_node",
        F.col("node_label").alias("goal_node"),
    )


def _path_graph(spark, d):
    normalized = A.normalized_events(spark, d)
    nodes = materialize(graph.dedup_nodes(graph.extract_nodes(normalized)), "nodes")
    edges = materialize(graph.extract_edges(normalized), "edges")
    level = F.create_map(
        F.lit("privilege_level"),
        F.when(F.length("node_label") % 4 > 0, (F.length("node_label") % 4).cast("string")),
    )
    return nodes.withColumn("properties", F.map_concat("properties", level)), edges


def _path_columns(answer, *extra):
    return answer.select(
        "request_id",
        "case_id",
        "start_node",
        "goal_node",
        "status",
        "is_path_found",
        F.when(F.col("is_path_found"), F.col("total_cost")).alias("total_cost"),
        F.array_join("path", " > ").alias("path"),
        "visited_nodes_count",
        *extra,
    )


@query
def cheapest_path(spark, d):
    nodes, edges = _path_graph(spark, d)
    return _path_columns(paths.cheapest_path(_path_requests(nodes), nodes, edges))


@query
def goal_path(spark, d):
    nodes, edges = _path_graph(spark, d)
    answer = paths.goal_directed_path(_path_requests(nodes), nodes, edges)
    return _path_columns(answer, "heuristic_cost").drop("visited_nodes_count")


@query
def own_heuristic(spark, d):
    """A caller's heuristic that never overestimates, used to narrow the search: any other vertex is a least step away."""
    nodes, edges = _path_graph(spark, d)

    def least_step(vertex, goal, *levels):
        return F.when(vertex == goal, 0.0).otherwise(0.01)

    answer = paths.goal_directed_path(_path_requests(nodes), nodes, edges, heuristic=least_step, admissible=True)
    return _path_columns(answer, "heuristic_cost")


@query
def path_resolution(spark, d):
    """Requests that name a node by label, by id, or not at all, and cases without a graph."""
    nodes, _ = _path_graph(spark, d)
    known = nodes.where(F.col("node_type").isin("User", "Process", "Host")).select(
        "case_id", "node_label", "node_id", F.length("node_label").alias("n")
    )
    requests = known.select(
        F.concat_ws(">", "node_id", F.lit("r")).alias("request_id"),
        F.when(F.col("n") % 7 == 0, F.col("case_id") + 1_000_000).otherwise(F.col("case_id")).alias("case_id"),
        F.when(F.col("n") % 2 == 0, F.col("node_id")).otherwise(F.col("node_label")).alias("start_node"),
        F.when(F.col("n") % 3 == 0, F.lit("nowhere")).otherwise(F.col("node_label")).alias("goal_node"),
    )
    resolved = paths.resolve_requests(requests, nodes, A.cases(spark, d))
    return resolved.select("request_id", "case_id", "start", "goal", "status")


# ---- validation ---------------------------------------------------------------------------------


def _validated(spark, d, node_columns=NODE_NAMES):
    nodes, edges = _stored_graph(spark, d, node_columns, EDGE_CHECKS)
    # One spawned edge in nine loses its source, so that the orphan rule has work to do.
    orphaned = (F.col("edge_type") == "SPAWNED") & F.col("edge_id").rlike("^[01]")
    edges = edges.withColumn("src_id", F.when(~orphaned, F.col("src_id")))
    return nodes, validate.failures(nodes, edges)


@query
def validate_nodes(spark, d):
    return _validated(spark, d)[1]


@query
def validate_summary(spark, d):
    nodes, found = _validated(spark, d)
    return validate.validation_summary(nodes, found)


@query
def validation_records(spark, d):
    nodes, found = _validated(spark, d)
    return validate.validation_records(found, validate.validation_summary(nodes, found))


@query
def validation_rules(spark, d):
    """Violations per rule of the catalogue, 0 included."""
    _, found = _validated(spark, d)
    counts = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("failures"))
    return (
        validate.rule_catalogue(spark)
        .join(counts, "rule_id", "left")
        .select("rule_id", "rule_name", "category", "severity", F.coalesce("failures", F.lit(0)).alias("failures"))
    )


@query
def resolved_nodes(spark, d):
    nodes, found = _validated(spark, d, ["*"])
    kept = validate.resolved_nodes(nodes, found).where(F.col("node_type") == "Process")
    return kept.select("case_id", "node_label", F.col("properties")["resolved_parent"].alias("resolved_parent"))


@query
def latest_validation(spark, d):
    return validate.latest_validation(A.validation_results(spark, d))


@query
def validation_status(spark, d):
    return validate.validation_status(A.cases(spark, d), A.validation_results(spark, d))


@query
def violations_newest(spark, d):
    stored = A.validation_results(spark, d).where(F.col("validation_status") == "FAILED")
    return validate.violations_newest(
        stored.select("case_id", F.col("result_id").alias("record_id"), F.col("validated_at").alias("created_at"), "violations_count")
    )


# ---- inference ------------------------------------------------------------------------------------


def _facts(spark, d):
    """Facts of the derived events, and given facts from the pages: one per url and case."""
    given = A.table(spark, d, "pages").select(
        F.expr(f"page_id % {A.CASES}").alias("case_id"),
        F.concat(F.lit("PAGE_"), F.col("page_id").cast("string")).alias("fact_id"),
        F.expr("CASE page_id % 3 WHEN 0 THEN 'MASS_FILE_RENAME' WHEN 1 THEN 'PROCESS_CREATE' ELSE 'NOTE' END").alias("fact_type"),
        F.concat(F.lit("page:"), F.expr("page_id % 40").cast("string")).alias("entity"),
        F.expr("CASE page_id % 5 WHEN 0 THEN 'PowerShell -enc' WHEN 1 THEN 'vssadmin list' ELSE 'True' END").alias("value"),
        F.lit(1.0).alias("confidence"),
        F.create_map(F.lit("url"), F.col("url")).alias("properties"),
    )
    return inference.facts_from_events(A.normalized_events(spark, d), custom=given.select(*FACT.fieldNames()))


@query
def facts(spark, d):
    return _facts(spark, d).drop("properties")


@query
def facts_numbered(spark, d):
    return inference.facts_from_events(A.normalized_events(spark, d), numbered=True).drop("properties")


@query
def distinct_facts(spark, d):
    return inference.distinct_facts(_facts(spark, d))


@query
def auth_failure_burst(spark, d):
    return inference.auth_failure_burst(inference.event_facts(A.normalized_events(spark, d))).drop("__number")


@query
def inference_summary(spark, d):
    return inference.inference_summary(_facts(spark, d))


@query
def derived_facts(spark, d):
    return inference.derived_facts(_facts(spark, d))


@query
def own_rule(spark, d):
    """Two rules of a caller, the second of which follows from the first."""
    kind = F.col("fact_type")
    rules = [
        inference.InferenceRule(
            "OWN_01", "Noted renames", "FILES", "LOW", (kind == "NOTE", kind == "MASS_FILE_RENAME"),
            (inference.Conclusion("OWN_F1", "OWN_NOTED", "files", "renamed", 0.5),),
        ),
        inference.InferenceRule("OWN_02", "Follows", "FILES", "LOW", (kind == "OWN_NOTED",), (inference.Conclusion("OWN_F2", "OWN_CHAINED", "files", "twice", 0.25),)),
    ]
    return inference.derived_facts(_facts(spark, d), rules)


@query
def fired_rules(spark, d):
    return inference.fired_rules(_facts(spark, d)).withColumn("derived_facts", F.array_join("derived_facts", ";"))


@query
def rule_triggers(spark, d):
    return inference.rule_triggers(_facts(spark, d))


# ---- reports ---------------------------------------------------------------------------------------


@query
def risk_score(spark, d):
    nodes = graph.build_nodes(A.normalized_events(spark, d))
    return report.risk_score(nodes, A.validation_results(spark, d).groupBy("case_id").agg(F.max("validation_score").alias("validation_score")))


@query
def risk_nodes(spark, d):
    return report.scored_nodes(graph.build_nodes(A.normalized_events(spark, d))).drop("node_id")


@query
def risk_highlights(spark, d):
    return report.highlights(graph.build_nodes(A.normalized_events(spark, d)))


@query
def case_context(spark, d):
    events = A.case_events(spark, d)
    nodes = graph.build_nodes(A.normalized_events(spark, d))
    return report.case_context(A.cases(spark, d), A.event_evidence(spark, d), nodes, events)


@query
def investigation_prompt(spark, d):
    events = A.case_events(spark, d)
    alerts = detect.detect(events, detect.detection_rules(spark))
    return report.investigation_prompt(A.cases(spark, d), alerts, events)



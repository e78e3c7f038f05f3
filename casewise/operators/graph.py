"""Entity graph of a case: nodes, weighted edges and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.scoring import edge_weight, event_label, evidence_label, user_label
from casewise.functions.text import contains_any, first_present, present
from casewise.functions.timestamps import utc_text
from casewise.operators.skew import lookup_large

PROPERTIES = "map<string,string>"


def _map(**entries: Column) -> Column:
    pairs = [item for name, value in entries.items() for item in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs).cast(PROPERTIES) if pairs else F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    )


def node_key(case_id: Column, node_type: Column, label: Column) -> Column:
    return F.sha2(F.concat_ws("|", case_id.cast("string"), node_type, label), 256)


def _node(when: Column, node_type: str, label: Column, properties: Column) -> Column:
    return F.when(
        when,
        F.struct(F.lit(node_type).alias("node_type"), label.alias("node_label"), properties.alias("properties")),
    )


def _known(name: str) -> Column:
    return present(F.col(name)).isNotNull()


def _labels() -> dict[str, Column]:
    return {
        "host": first_present([F.col("hostname")], "UNKNOWN_HOST"),
        "user": user_label(F.col("domain"), F.col("username")),
        "event": event_label(F.col("event_uid")),
        "evidence": evidence_label(F.col("evidence_id")),
    }


def _authentication_edge() -> Column:
    return (F.col("event_category") == "Authentication") & F.col("action").isin("AUTH_SUCCESS", "AUTH_FAILURE")


def extract_nodes(normalized: DataFrame) -> DataFrame:
    """Entity descriptors of each event, not yet merged; one pass without a shuffle.

    The event's own node is unique by construction and comes from ``event_nodes``.
    A host or user that exists only as the end of an edge gets an empty property map.
    """
    label = _labels()
    named_host, named_user = _known("hostname"), _known("username")
    user_end = _authentication_edge() | _known("process_name") | _known("file_path") | _known("registry_key")
    items = [
        _node(
            named_host, "Host", F.col("hostname"), _map(device_name=F.col("device_name"), case_id=F.col("case_id"))
        ),
        _node(~named_host & _authentication_edge(), "Host", label["host"], _map()),
        _node(named_user, "User", label["user"], _map(username=F.col("username"), domain=F.col("domain"))),
        _node(~named_user & user_end, "User", label["user"], _map()),
        _node(_known("ip_address"), "IP_Address", F.col("ip_address"), _map(type=F.lit("source_ip"))),
        _node(
            _known("destination_ip"),
            "IP_Address",
            F.col("destination_ip"),
            _map(type=F.lit("destination_ip"), port=F.col("destination_port")),
        ),
        _node(
            _known("process_name"),
            "Process",
            F.col("process_name"),
            _map(process_id=F.col("process_id"), command_line=F.col("command_line")),
        ),
        _node(_known("parent_process"), "Parent_Process", F.col("parent_process"), _map()),
        _node(_known("file_path"), "File", F.col("file_path"), _map(object_name=F.col("object_name"))),
        _node(_known("registry_key"), "Registry_Key", F.col("registry_key"), _map()),
        _node(F.lit(True), "Evidence", label["evidence"], _map(evidence_id=F.col("evidence_id"))),
    ]
    descriptors = F.filter(F.array(*items), lambda n: n.isNotNull())
    return normalized.select(
        "case_id", "timestamp_utc", "event_uid", F.posexplode(descriptors).alias("slot", "node")
    ).select(
        "case_id",
        F.col("node.node_type").alias("node_type"),
        F.trim(F.col("node.node_label")).alias("node_label"),
        F.col("node.properties").alias("properties"),
        F.struct("timestamp_utc", "event_uid", "slot").alias("seen"),
    )


def event_nodes(normalized: DataFrame) -> DataFrame:
    """One node per event; needs no deduplication."""
    label = event_label(F.col("event_uid"))
    return normalized.select(
        "case_id",
        node_key(F.col("case_id"), F.lit("Normalized_Event"), label).alias("node_id"),
        F.lit("Normalized_Event").alias("node_type"),
        label.alias("node_label"),
        _map(
            event_uuid=F.col("event_uid"),
            action=F.col("action"),
            category=F.col("event_category"),
            severity=F.col("severity"),
            timestamp=utc_text(F.col("timestamp_utc"), "T"),
        ).alias("properties"),
    )


def dedup_nodes(descriptors: DataFrame) -> DataFrame:
    """One node per (case, type, label); of equal property names the latest value wins, null included.

    The winner per property comes from a partially aggregated maximum, so the descriptors of
    a hot entity are reduced inside each task before they meet.
    """
    entity = ["case_id", "node_type", "node_label"]
    single = descriptors.select(
        *entity, "seen", F.explode_outer(F.map_entries("properties")).alias("entry")
    ).select(*entity, "seen", F.col("entry.key").alias("name"), F.struct(F.col("entry.value")).alias("held"))
    latest = single.groupBy(*entity, "name").agg(F.max_by("held", "seen").alias("held"))
    pairs = F.collect_list(
        F.when(F.col("name").isNotNull(), F.struct(F.col("name"), F.col("held.value").alias("value")))
    )
    merged = latest.groupBy(*entity).agg(F.map_from_entries(F.array_sort(pairs)).alias("properties"))
    return merged.select(
        "case_id",
        node_key(F.col("case_id"), F.col("node_type"), F.col("node_label")).alias("node_id"),
        "node_type",
        "node_label",
        "properties",
    )


def build_nodes(normalized: DataFrame) -> DataFrame:
    return dedup_nodes(extract_nodes(normalized)).unionByName(event_nodes(normalized))


def _edge(when: Column, src: tuple[Column, Column], dst: tuple[Column, Column], edge_type: Column, confidence: Column, properties: Column) -> Column:
    return F.when(
        when,
        F.struct(
            src[0].alias("src_type"), src[1].alias("src_label"), dst[0].alias("dst_type"), dst[1].alias("dst_label"),
            edge_type.alias("edge_type"), confidence.alias("confidence"), properties.alias("properties"),
        ),
    )


def file_edge_type(action: Column) -> Column:
    lowered = F.lower(F.coalesce(action, F.lit("")))
    chosen = F.lit(X.FILE_EDGE_OTHERWISE)
    for name, words in reversed(X.FILE_EDGE_WORDS):
        chosen = F.when(contains_any(lowered, words), name).otherwise(chosen)
    return chosen


def extract_edges(normalized: DataFrame) -> DataFrame:
    """Directed relationships of each event with weights; parallel edges are kept."""
    label, own = _labels(), F.col("confidence_score")
    host, user = (F.lit("Host"), label["host"]), (F.lit("User"), label["user"])
    process = (F.lit("Process"), F.col("process_name"))
    actor = (
        F.when(_known("process_name"), "Process").otherwise("User"),
        F.when(_known("process_name"), F.col("process_name")).otherwise(label["user"]),
    )
    items = [
        _edge(
            _authentication_edge(), user, host,
            F.when(F.col("action") == "AUTH_SUCCESS", "AUTHENTICATED").otherwise("FAILED_AUTH"),
            own, _map(action=F.col("action"), ip=F.col("ip_address")),
        ),
        _edge(
            _known("process_name"), user, process, F.lit("EXECUTED"), own,
            _map(pid=F.col("process_id"), cmd=F.col("command_line")),
        ),
        _edge(
            _known("process_name") & _known("parent_process"),
            (F.lit("Parent_Process"), F.col("parent_process")), process, F.lit("SPAWNED"), own,
            _map(parent=F.col("parent_process")),
        ),
        _edge(
            _known("file_path"), actor, (F.lit("File"), F.col("file_path")), file_edge_type(F.col("action")), own,
            _map(file=F.col("file_path")),
        ),
        _edge(
            _known("ip_address") & _known("destination_ip"),
            (F.lit("IP_Address"), F.col("ip_address")), (F.lit("IP_Address"), F.col("destination_ip")),
            F.lit("COMMUNICATED_WITH"), own,
            _map(port=F.col("destination_port"), protocol=F.col("network_protocol")),
        ),
        _edge(
            _known("registry_key"), actor, (F.lit("Registry_Key"), F.col("registry_key")), F.lit("PERSISTED"), own,
            _map(key=F.col("registry_key")),
        ),
        _edge(
            F.lit(True), (F.lit("Normalized_Event"), label["event"]), (F.lit("Evidence"), label["evidence"]),
            F.lit("BELONGS_TO"), F.lit(1.0), _map(event_uuid=F.col("event_uid")),
        ),
    ]
    relations = F.filter(F.array(*items), lambda e: e.isNotNull())
    case = F.col("case_id")
    src, dst = F.trim(F.col("edge.src_label")), F.trim(F.col("edge.dst_label"))
    return normalized.select(
        "case_id", "event_uid", "timestamp_utc", "severity", F.posexplode(relations).alias("slot", "edge")
    ).select(
        "case_id",
        F.sha2(F.concat_ws("|", case.cast("string"), F.col("event_uid"), F.col("edge.edge_type")), 256).alias("edge_id"),
        node_key(case, F.col("edge.src_type"), src).alias("src_id"),
        node_key(case, F.col("edge.dst_type"), dst).alias("dst_id"),
        src.alias("src_label"),
        dst.alias("dst_label"),
        F.col("edge.edge_type").alias("edge_type"),
        edge_weight(F.col("severity"), F.col("edge.confidence")).alias("weight"),
        F.col("edge.confidence").alias("confidence"),
        F.col("timestamp_utc").alias("timestamp"),
        F.col("edge.properties").alias("properties"),
    )


def build_graph(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every case. Ids are hashes, so the edges need no join to the nodes."""
    return build_nodes(normalized), extract_edges(normalized)


def graph_metadata(
    nodes: DataFrame, edges: DataFrame, cases: DataFrame | None = None, components: DataFrame | None = None
) -> DataFrame:
    """Node and edge counts and density per case; zeros for a listed case without a graph."""
    n = nodes.groupBy("case_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("edge_count"))
    counted = n.join(e, "case_id", "full_outer")
    if cases is not None:
        counted = cases.select("case_id").join(counted, "case_id", "left")
    if components is not None:
        counted = counted.join(
            component_counts(components).withColumnRenamed("components", "connected_components"), "case_id", "left"
        )
    pairs = F.col("node_count").cast("double") * (F.col("node_count") - 1)
    shown = counted.fillna(0)
    return shown.withColumn(
        "density",
        F.when(F.col("node_count") > 1, F.round(F.col("edge_count") / pairs, 4)).otherwise(0.0),
    )


def component_counts(components: DataFrame) -> DataFrame:
    """Number of components per case; each component is counted at its root node."""
    root = F.col("node_id") == F.col("component_id")
    return components.groupBy("case_id").agg(F.count_if(root).alias("components"))


def graph_export(nodes: DataFrame, edges: DataFrame, case_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and metadata of one case."""
    own_nodes = nodes.where(F.col("case_id") == case_id)
    own_edges = edges.where(F.col("case_id") == case_id)
    return own_nodes, own_edges, graph_metadata(own_nodes, own_edges)


def edge_ends(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge once per end point under ``node_id``; a self-loop appears twice, a missing end not at all."""
    ends = F.array(F.col("src_id"), F.col("dst_id"))
    return edges.select("case_id", F.explode(ends).alias("node_id"), *columns).where(
        F.col("node_id").isNotNull() & (F.col("node_id") != "")
    )


def incident_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node labels joined to their edges; nodes are many, so only hot ones have copies in the skew-safe lookup."""
    ends = edge_ends(edges, "edge_id", "edge_type", "src_id", "dst_id", "timestamp", "properties")
    names = nodes.select("case_id", "node_id", "node_type", "node_label")
    joined = lookup_large(ends, names, ["case_id", "node_id"])
    return joined.where(F.col("node_type").isNotNull())


def incident_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with the number of its edges, 0 included."""
    degree = edge_ends(edges).groupBy("case_id", "node_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return (
        nodes.select("case_id", "node_id", "node_type", "node_label")
        .join(degree, ["case_id", "node_id"], "left")
        .withColumn("edge_count", F.coalesce(F.col("edge_count"), F.lit(0)))
    )

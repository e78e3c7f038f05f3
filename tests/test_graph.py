"""Graph building, components, paths and validation."""

import heapq
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casewise.functions.scoring import privilege_gap, zero_heuristic
from casewise.operators import components, graph, paths, validate
from casewise.schemas import NORMALIZED_EVENT
from conftest import rows

AT = datetime(2026, 3, 1, 10)


def normalized(spark, *events):
    """Normalized events from partial dicts."""
    fields = [f for f in NORMALIZED_EVENT.fields if f.name != "raw_event_reference"]
    data = []
    for i, event in enumerate(events):
        base = {"event_uid": f"e{i}", "case_id": 1, "evidence_id": 3, "seq": i, "timestamp_utc": AT.replace(minute=i % 60),
                "event_category": "Unknown", "severity": "low", "action": "GENERIC_EVENT", "confidence_score": 0.9}
        base.update(event)
        data.append(tuple(base.get(f.name) for f in fields))
    schema = type(NORMALIZED_EVENT)(fields)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def one_event(spark):
    return normalized(spark, {
        "hostname": "DC-01", "device_name": "DC-01", "username": "admin", "domain": "CORP", "ip_address": "10.0.0.5",
        "process_name": "powershell.exe", "parent_process": "cmd.exe", "event_category": "Authentication",
        "action": "AUTH_SUCCESS", "severity": "critical",
    })


def test_nodes_of_one_event(one_event):
    got = rows(graph.build_nodes(one_event), "node_type", "node_label")
    assert got == sorted([
        ("Host", "DC-01"), ("User", "CORP\\admin"), ("IP_Address", "10.0.0.5"), ("Process", "powershell.exe"),
        ("Parent_Process", "cmd.exe"), ("Evidence", "Evidence_3"), ("Normalized_Event", "Event_e0"),
    ])


def test_edges_of_one_event(one_event):
    got = rows(graph.extract_edges(one_event), "edge_type", "src_label", "dst_label", "weight")
    assert got == sorted([
        ("AUTHENTICATED", "CORP\\admin", "DC-01", 0.222), ("EXECUTED", "CORP\\admin", "powershell.exe", 0.222),
        ("SPAWNED", "cmd.exe", "powershell.exe", 0.222), ("BELONGS_TO", "Event_e0", "Evidence_3", 0.2),
    ])


def test_every_edge_end_is_a_node(spark):
    events = normalized(
        spark,
        {"hostname": None, "username": None, "event_category": "Authentication", "action": "AUTH_FAILURE"},
        {"hostname": " h ", "username": "u", "file_path": "/f", "action": "OBJECT_READ"},
        {"username": None, "registry_key": "K", "process_name": "p", "file_path": "/g", "action": "FILE_DELETE"},
    )
    nodes, edges = graph.build_graph(events)
    ids = {r["node_id"] for r in nodes.collect()}
    assert all(r["src_id"] in ids and r["dst_id"] in ids for r in edges.collect())
    assert nodes.where("node_label = 'UNKNOWN_HOST'").count() == 1
    assert nodes.where("node_label = 'h'").count() == 1
    kinds = {r["edge_type"] for r in edges.collect()}
    assert kinds == {"FAILED_AUTH", "READ", "DELETED", "PERSISTED", "EXECUTED", "BELONGS_TO"}


def test_latest_property_wins_even_when_null(spark):
    events = normalized(
        spark,
        {"process_name": "p", "process_id": "1", "command_line": "first"},
        {"process_name": "p", "process_id": "2", "command_line": None},
        {"ip_address": "1.1.1.1", "destination_ip": "2.2.2.2", "destination_port": 80},
        {"ip_address": "2.2.2.2"},
    )
    held = {(r["node_type"], r["node_label"]): r["properties"] for r in graph.build_nodes(events).collect()}
    assert held["Process", "p"] == {"process_id": "2", "command_line": None}
    assert held["IP_Address", "2.2.2.2"] == {"type": "source_ip", "port": "80"}


def test_metadata(spark):
    nodes, edges = graph.build_graph(normalized(spark, {"hostname": "h", "username": "u"}))
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    found = components.connected_components(nodes, edges)
    got = rows(graph.graph_metadata(nodes, edges, cases, found), "case_id", "node_count", "edge_count", "density", "connected_components")
    assert got == [(1, 4, 1, 0.0833, 3), (2, 0, 0, 0.0, 0)]
    mine, own, meta = graph.graph_export(nodes, edges, 1)
    assert (mine.count(), own.count(), meta.first()["node_count"]) == (4, 1, 4)


def test_incident_edges(spark):
    nodes = spark.createDataFrame([(1, "a", "T", "A"), (1, "b", "T", "B"), (1, "c", "T", "C")], "case_id long, node_id string, node_type string, node_label string")
    edges = spark.createDataFrame(
        [(1, "e1", "a", "b", "X"), (1, "e2", "a", "a", "X"), (1, "e3", None, "b", "X"), (1, "e4", "z", "b", "X")],
        "case_id long, edge_id string, src_id string, dst_id string, edge_type string",
    ).withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("properties", F.lit(None).cast("map<string,string>"))
    got = rows(graph.incident_edges(nodes, edges), "node_label", "edge_id")
    assert got == [("A", "e1"), ("A", "e2"), ("A", "e2"), ("B", "e1"), ("B", "e3"), ("B", "e4")]
    assert rows(graph.incident_counts(nodes, edges), "node_label", "edge_count") == [("A", 3), ("B", 3), ("C", 0)]


def random_graph(seed, count, links, cases=2):
    rng = random.Random(seed)
    nodes = [(case, f"n{i:03d}") for case in range(cases) for i in range(count)]
    edges = []
    for case in range(cases):
        hub = "n000"
        for _ in range(links):
            a, b = f"n{rng.randrange(count):03d}", f"n{rng.randrange(count):03d}"
            edges.append((case, hub if rng.random() < 0.33 else a, b, round(rng.uniform(0.2, 5), 3)))
    return nodes, edges


def frames(spark, nodes, edges):
    node_frame = spark.createDataFrame(nodes, "case_id long, node_label string").select(
        "case_id", F.concat(F.lit("id-"), "node_label").alias("node_id"), F.lit("T").alias("node_type"), "node_label",
        F.create_map(F.lit("privilege_level"), F.substring("node_label", 4, 1)).alias("properties"),
    )
    edge_frame = spark.createDataFrame(edges, "case_id long, src_label string, dst_label string, weight double").withColumns({
        "src_id": F.concat(F.lit("id-"), "src_label"), "dst_id": F.concat(F.lit("id-"), "dst_label"),
    })
    return node_frame, edge_frame


def test_components_against_union_find(spark):
    nodes, edges = random_graph(3, 120, 70)
    chain = [(0, f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(60, 100)]
    edges = edges + chain
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for case, a, b, _ in edges:
        ra, rb = find((case, a)), find((case, b))
        parent[max(ra, rb)] = min(ra, rb)
    want = sorted((case, f"id-{label}", f"id-{find((case, label))[1]}") for case, label in nodes)
    node_frame, edge_frame = frames(spark, nodes, edges)
    assert rows(components.connected_components(node_frame, edge_frame)) == sorted(want, key=repr)


def test_folded_leaves_give_the_same_components(spark):
    nodes, edges = random_graph(5, 40, 25, cases=1)
    leaf = [(0, f"x{i:03d}", f"n{i % 7:03d}", 1.0) for i in range(50)] + [(0, f"a{i}", "n039", 1.0) for i in range(3)]
    node_frame, edge_frame = frames(spark, nodes + [(0, a) for _, a, _, _ in leaf], edges + leaf)
    typed = edge_frame.withColumn("edge_type", F.when(F.col("src_label").rlike("^[xa]"), "BELONGS_TO").otherwise("X"))
    plain = components.connected_components(node_frame, typed)
    folded = components.connected_components(node_frame, typed, leaf_edges="BELONGS_TO")
    assert rows(folded) == rows(plain)


def dijkstra(edges, case, start):
    out = {}
    for c, a, b, w in edges:
        if c == case:
            out.setdefault(a, []).append((b, max(0.01, w)))
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        cost, at = heapq.heappop(queue)
        if cost > best[at]:
            continue
        for b, w in out.get(at, ()):
            if cost + w < best.get(b, float("inf")):
                best[b] = cost + w
                heapq.heappush(queue, (cost + w, b))
    return best


@pytest.mark.parametrize("width,admissible", [(3, False), (10**6, False), (10**6, True)])
def test_paths_against_dijkstra(spark, width, admissible):
    nodes, edges = random_graph(11, 60, 200)
    node_frame, edge_frame = frames(spark, nodes, edges)
    wanted = [(f"{c}-{g}", c, "n001", f"n{g:03d}") for c in (0, 1) for g in range(0, 60, 4)]
    requests = spark.createDataFrame(wanted, "request_id string, case_id long, start_node string, goal_node string")
    if admissible:
        answer = paths.goal_directed_path(requests, node_frame, edge_frame, heuristic=zero_heuristic, admissible=True, width=width)
    else:
        answer = paths.cheapest_path(requests, node_frame, edge_frame, width=width)
    step = {}
    for c, a, b, w in edges:
        step[c, a, b] = min(step.get((c, a, b), 99.0), max(0.01, w))
    for row in answer.collect():
        best = dijkstra(edges, row["case_id"], "n001")
        goal = best.get(row["goal_node"])
        assert row["is_path_found"] == (goal is not None)
        if goal is None:
            assert (row["status"], row["path"], row["total_cost"]) == ("no_path", [], float("inf"))
            assert row["visited_nodes_count"] == len(best)
            continue
        assert row["total_cost"] == pytest.approx(goal, abs=1e-4)
        walked = sum(step[row["case_id"], a, b] for a, b in zip(row["path"], row["path"][1:]))
        assert walked == pytest.approx(goal, abs=1e-6)
        assert row["path"][0] == "n001" and row["path"][-1] == row["goal_node"]
        assert row["visited_nodes_count"] == sum(v < goal for v in best.values()) + 1


SIX = [("login", 1), ("usb_insert", 1), ("file_copy", 2), ("usb_remove", 3), ("isolated_exfil", 1), ("alt_pivot", 1)]
FIVE = [("login", "usb_insert", 1.0), ("usb_insert", "file_copy", 1.0), ("file_copy", "usb_remove", 1.0),
        ("login", "alt_pivot", 5.0), ("alt_pivot", "usb_remove", 5.0)]


def test_known_path_graph(spark):
    nodes = spark.createDataFrame([(1, str(i), "Event", n, {"privilege_level": str(p)}) for i, (n, p) in enumerate(SIX, 1)],
                                  "case_id long, node_id string, node_type string, node_label string, properties map<string,string>")
    edges = spark.createDataFrame([(1, a, b, w) for a, b, w in FIVE], "case_id long, src_label string, dst_label string, weight double")
    cases = spark.createDataFrame([(1, False), (2, False), (3, True)], "case_id long, is_deleted boolean")
    asked = [("r1", 1, "login", "usb_remove"), ("r2", 1, "login", "isolated_exfil"), ("r3", 1, "login", "login"), ("r4", 1, "1", "4"),
             ("r5", 9, "login", "login"), ("r6", 2, "login", "login"), ("r7", 1, "nope", "login"), ("r8", 1, "login", "nope"), ("r9", 3, "a", "b")]
    requests = spark.createDataFrame(asked, "request_id string, case_id long, start_node string, goal_node string")
    got = {r["request_id"]: r for r in paths.goal_directed_path(requests, nodes, edges, cases).collect()}
    assert got["r1"]["path"] == ["login", "usb_insert", "file_copy", "usb_remove"]
    assert (got["r1"]["total_cost"], got["r1"]["heuristic_cost"]) == (3.0, 1.0)
    assert got["r1"]["visited_nodes_count"] == 4
    assert (got["r2"]["status"], got["r2"]["visited_nodes_count"]) == ("no_path", 5)
    assert (got["r3"]["path"], got["r3"]["total_cost"], got["r3"]["visited_nodes_count"]) == (["login"], 0.0, 1)
    assert got["r4"]["path"] == got["r1"]["path"]
    assert [got[f"r{i}"]["status"] for i in (5, 6, 7, 8, 9)] == [
        "case_not_found", "empty_graph", "start_not_found", "goal_not_found", "case_not_found",
    ]


def test_long_chain(spark):
    links = [(1, f"N{i}", f"N{i + 1}", 1.0) for i in range(1, 20)] + [(1, "N1", "N10", 15.0)]
    nodes = spark.createDataFrame([(1, f"N{i}", "T", f"N{i}") for i in range(1, 21)], "case_id long, node_id string, node_type string, node_label string")
    edges = spark.createDataFrame(links, "case_id long, src_label string, dst_label string, weight double")
    requests = spark.createDataFrame([("r", 1, "N1", "N20")], "request_id string, case_id long, start_node string, goal_node string")
    row = paths.cheapest_path(requests, nodes, edges).first()
    assert len(row["path"]) == 20 and row["total_cost"] == 19.0


def test_privilege_gap(spark):
    row = spark.range(1).select(
        privilege_gap(F.lit("a"), F.lit("b"), F.lit(1), F.lit(3)).alias("up"),
        privilege_gap(F.lit("a"), F.lit("b"), F.lit(3), F.lit(1)).alias("down"),
        privilege_gap(F.lit("a"), F.lit("a"), F.lit(1), F.lit(3)).alias("there"),
        privilege_gap(F.lit("a"), F.lit("b"), F.lit(None), F.lit(2)).alias("unknown"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.5)


def check(spark, nodes, edges, rules=None):
    node_frame = spark.createDataFrame([(1, i, t, i) for i, t in nodes], "case_id long, node_id string, node_type string, node_label string")
    node_frame = node_frame.withColumn("properties", F.create_map().cast("map<string,string>"))
    edge_frame = spark.createDataFrame(
        [(1, f"e{n}", a, b, t, AT, {"port": p} if p is not None else {}) for n, (a, b, t, p) in enumerate(edges)],
        "case_id long, edge_id string, src_id string, dst_id string, edge_type string, timestamp timestamp, properties map<string,string>",
    )
    found = validate.failures(node_frame, edge_frame, rules)
    return node_frame, found, validate.validation_summary(node_frame, found, rules)


def test_orphan_process_is_resolved(spark):
    nodes, found, summary = check(spark, [("p", "Process")], [(None, "p", "SPAWNED", None)])
    assert rows(found, "status", "violation_reason") == [
        ("RESOLVED", "Orphan process execution on 'p': Missing parent process link.")]
    assert rows(summary) == [(1, "PASSED", 100.0, 0, 1, 1.0)]
    assert validate.resolved_nodes(nodes, found).first()["properties"] == {"resolved_parent": "SYSTEM_ROOT"}


def test_rules_pass_and_fail(spark):
    nodes = [("f1", "File"), ("f2", "File"), ("u1", "User"), ("u2", "User"), ("u3", "User"), ("i1", "IP_Address"), ("i2", "IP_Address"),
             ("h", "Host"), ("p", "Process")]
    edges = [("p", "f1", "DELETED", None), ("p", "f2", "DELETED", None), ("p", "f2", "READ", None),
             ("u1", "h", "FAILED_AUTH", None), ("u1", "p", "EXECUTED", None),
             ("u2", "h", "FAILED_AUTH", None), ("u2", "p", "EXECUTED", None), ("u2", "h", "AUTHENTICATED", None),
             ("u3", "h", "FAILED_AUTH", None),
             ("i1", "i2", "COMMUNICATED_WITH", "70000"), ("i2", "i2", "COMMUNICATED_WITH", "0"), ("i2", "i2", "COMMUNICATED_WITH", "")]
    _, found, summary = check(spark, nodes, edges)
    assert rows(found, "rule_id", "node_label", "status") == [
        (3, "f1", "VIOLATION"), (4, "u1", "VIOLATION"), (5, "i1", "VIOLATION"), (5, "i2", "VIOLATION")]
    assert rows(found.where("rule_id = 5"), "violation_reason")[0] == ("Network port boundary violation on 'i1': Invalid port 70000.",)
    row = summary.first()
    assert (row["validation_status"], row["validation_score"], row["confidence_score"]) == ("PARTIAL", 91.11, 0.91)
    records = validate.validation_records(found, summary)
    assert {r["confidence"] for r in records.collect()} == {0.91}


def test_own_constraint_rule(spark):
    busy = validate.ConstraintRule(
        "Busy", "Load", "Too many edges.", "low", "Host", None, {"n_edges": F.count(F.lit(1))}, F.col("n_edges") > 1,
        F.concat(F.lit("busy "), F.col("node_label")), "Re-order event timeline sequence.", "Put in order.",
    )
    _, found, summary = check(spark, [("h", "Host"), ("k", "Host")], [("h", "k", "X", None), ("h", "z", "Y", None)], [busy])
    assert rows(found, "node_label", "status") == [("h", "RESOLVED")]
    assert summary.first()["validation_score"] == 100.0
    assert validate.rule_catalogue(spark).count() == 5


def test_latest_and_status(spark):
    stored = spark.createDataFrame(
        [(1, 1, AT, "FAILED", 10.0, 5, 0, 0.5), (2, 1, AT.replace(hour=11), "PASSED", 100.0, 0, 1, 1.0)],
        "result_id long, case_id long, validated_at timestamp, validation_status string, validation_score double, "
        "violations_count long, resolved_count long, confidence_score double",
    )
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    assert rows(validate.validation_status(cases, stored)) == [
        (1, "PASSED", 100.0, 0, 1, 1.0), (2, "UNVALIDATED", 0.0, 0, 0, 0.0)]

"""Operators on small hand-made frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from casewise.functions import scoring
from casewise.functions.events import universal_event
from casewise.functions.normalize import domain_and_user, first_address, normalize
from casewise.functions.text import like_any
from casewise.functions.timestamps import epoch_to_utc, iso_to_utc, syslog_time, to_utc, utc_text
from casewise.operators import correlate, detect, evidence, report, search, timeline
from casewise.sources.csv_files import read_csv_events
from casewise.sources.files import Origin
from conftest import rows

START = datetime(2026, 7, 28, 9, 12)

SAMPLE = """timestamp,event_type,user,host,ip_address,severity,description
2026-07-28 09:12:01,Failed Logon,Administrator,DC-01,192.168.1.105,high,Failed logon attempt from 192.168.1.105
2026-07-28 09:12:05,Failed Logon,Administrator,DC-01,192.168.1.105,high,Failed logon attempt from 192.168.1.105
2026-07-28 09:12:10,Failed Logon,Administrator,DC-01,192.168.1.105,high,Failed logon attempt from 192.168.1.105
2026-07-28 09:12:15,Successful Logon,Administrator,DC-01,192.168.1.105,low,Successful logon for Administrator
2026-07-28 09:13:00,Special Privileges Assigned,Administrator,DC-01,192.168.1.105,high,Special privileges assigned
2026-07-28 09:15:30,Process Created,Administrator,DC-01,192.168.1.105,medium,Process powershell.exe spawned cmd.exe
2026-07-28 09:20:00,Audit Log Cleared,Administrator,DC-01,192.168.1.105,critical,Windows Security log cleared
"""


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "sample.csv"
    path.write_text(SAMPLE)
    return read_csv_events(spark, str(path), Origin(case_id=1, evidence_id=1))


def test_normalized_sample(sample):
    got = [tuple(r) for r in normalize(sample).orderBy("timestamp_utc").select("event_category", "action", "severity").collect()]
    assert got == [("Authentication", "AUTH_SUCCESS", "high")] * 4 + [
        ("Unknown", "GENERIC_EVENT", "low"),
        ("Process Execution", "PROCESS_CREATE", "medium"),
        ("Unknown", "GENERIC_EVENT", "low"),
    ]
    weights = normalize(sample).orderBy("timestamp_utc").select(
        scoring.edge_weight(F.col("severity"), F.col("confidence_score")).alias("w")
    )
    assert [r["w"] for r in weights.collect()] == [0.714, 0.714, 0.714, 2.5, 1.429, 4.167, 1.111]


def test_correlation_of_sample(sample):
    got = correlate.correlate_events(sample)
    assert {(r["correlation_count"], r["is_suspicious"], r["confidence_score"]) for r in got.collect()} == {(12, True, 0.95)}


def test_correlation_rules(spark):
    data = [Row(event_uid=str(i), case_id=1, user=u, ip_address=ip, is_suspicious=False, confidence_score=0.2)
            for i, (u, ip) in enumerate([("a", "x"), ("a", "x"), ("a", ""), ("", "x"), (None, None), ("b", "x")])]
    frame = spark.createDataFrame(data, "event_uid string, case_id long, user string, ip_address string, is_suspicious boolean, confidence_score double")
    got = {r["event_uid"]: (r["correlation_count"], r["is_suspicious"], r["confidence_score"])
           for r in correlate.correlate_events(frame).collect()}
    assert got == {
        "0": (5, True, 0.75), "1": (5, True, 0.75), "2": (2, False, 0.2), "3": (3, False, 0.2),
        "4": (0, False, 0.2), "5": (3, False, 0.2),
    }


def test_detection_of_sample(spark, sample):
    alerts = detect.detect(sample, detect.detection_rules(spark))
    assert rows(alerts, "rule_name", "event_count", "severity") == [
        ("log_cleared", 1, "critical"), ("privilege_escalation", 1, "high"),
    ]
    lower = detect.detection_rules(spark, [("three_failures", "Three", "Failed Logon", 3, "low", 0.5)])
    three = detect.detect(sample, lower).where("rule_name = 'three_failures'").first()
    assert three["event_count"] == 3 and len(three["events"]) == 3


def test_windowed_brute_force(spark):
    data = [(1, "u", "Failed Logon", START + timedelta(minutes=m)) for m in (0, 1, 2, 3, 4, 9, 30)]
    events = spark.createDataFrame(data, "case_id long, user string, event_type string, timestamp timestamp")
    got = rows(detect.windowed_brute_force(events))
    assert got == [(1, "u", datetime(2026, 7, 28, 9, 10), datetime(2026, 7, 28, 9, 20), 5)]


def test_timeline(spark):
    data = [(1, "b", 2, START), (1, "a", 1, START), (1, "z", 9, None), (2, "c", 1, START + timedelta(1)), (2, "d", 2, START)]
    events = spark.createDataFrame(data, "case_id long, event_uid string, seq long, timestamp timestamp")
    got = rows(timeline.build_timeline(events), "case_id", "sequence_id", "event_uid")
    assert got == [(1, 1, "z"), (1, 2, "a"), (1, 3, "b"), (2, 1, "d"), (2, 2, "c")]


def test_case_events_takes_case_from_evidence(spark):
    events = spark.createDataFrame([("e1", 1, 99), ("e2", 2, 99), ("e3", 7, 99)], "event_uid string, evidence_id long, case_id long")
    files = spark.createDataFrame([(1, 10, False), (2, 20, True)], "evidence_id long, case_id long, is_deleted boolean")
    assert rows(timeline.case_events(events, files), "event_uid", "case_id") == [("e1", 10), ("e2", 20)]
    assert rows(timeline.case_events(events, files, exclude_deleted=True), "event_uid", "case_id") == [("e1", 10)]


def test_times(spark):
    texts = ["2026-01-02", "2026-01-02T03:04:05Z", "2026-01-02 03:04:05.25+02:00", "2026", "12:00", "x", "", None, "2026-13-01"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(iso_to_utc(F.col("t"))).collect()]
    assert got[:3] == [datetime(2026, 1, 2), datetime(2026, 1, 2, 3, 4, 5), datetime(2026, 1, 2, 1, 4, 5, 250000)]
    assert got[3:] == [None] * 6
    one = spark.range(1).select(
        epoch_to_utc(F.lit(1.5)).alias("a"),
        to_utc(F.lit("bad"), "iso", F.lit("2026-01-01").cast("timestamp")).alias("b"),
        syslog_time(F.lit("Mar"), F.lit("9"), F.lit("01:02:03"), 2026).alias("c"),
        syslog_time(F.lit("Xyz"), F.lit("9"), F.lit("01:02:03"), 2026).alias("d"),
        syslog_time(F.lit("Feb"), F.lit("29"), F.lit("01:02:03"), 2026).alias("e"),
        utc_text(F.lit("2026-01-02 03:04:05.5").cast("timestamp")).alias("f"),
        utc_text(F.lit("2026-01-02 03:04:05").cast("timestamp"), "T").alias("g"),
    ).first()
    assert one["a"] == datetime(1970, 1, 1, 0, 0, 1, 500000)
    assert one["b"] == datetime(2026, 1, 1)
    assert (one["c"], one["d"], one["e"]) == (datetime(2026, 3, 9, 1, 2, 3), datetime(2026, 1, 9, 1, 2, 3), None)
    assert (one["f"], one["g"]) == ("2026-01-02 03:04:05.500000+00:00", "2026-01-02T03:04:05+00:00")


def test_field_extraction(spark):
    frame = spark.createDataFrame([("CORP\\jdoe",), ("a@b@c",), ("x\\y\\z",), ("plain",), ("",)], "u string")
    got = [tuple(r[0]) for r in frame.select(domain_and_user(F.col("u"))).collect()]
    assert got == [("CORP", "jdoe"), ("b@c", "a"), ("x", "y\\z"), (None, None), (None, None)]
    row = spark.range(1).select(first_address(F.lit("to 192.168.1.50 and 1.2.3.4")), first_address(F.lit("v1.2.3"))).first()
    assert tuple(row) == ("192.168.1.50", None)


def test_universal_event_defaults(spark):
    base = spark.range(1).select(F.lit(1).alias("case_id"), F.lit(2).alias("evidence_id"), F.lit(3).alias("seq"))
    row = universal_event(base, {"severity": F.lit("HIGH"), "host": F.lit("h" * 150)}, F.lit("2026-01-01").cast("timestamp")).first()
    assert (len(row["host"]), row["user"], row["severity"], row["confidence_score"], row["is_suspicious"]) == (150, "UNKNOWN_USER", "high", 0.7, True)
    assert row["description"] == "Parsed event from None" and row["ts_inferred"]


def test_raw_fields(spark):
    records = [
        '{"CommandLine":"","cmd":"run","DestinationPort":"80a","pid":7,"nested":{"CommandLine":"no"}}',
        '{"command_line":"c2","dest_port":443,"DestinationIp":"1.1.1.1","Protocol":"UDP","parent_process":"p"}',
    ]
    base = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "seq long, r string")
    events = universal_event(
        base.withColumn("case_id", F.lit(1)).withColumn("evidence_id", F.lit(1)),
        {"raw_data": F.parse_json("r")}, F.lit("2026-01-01").cast("timestamp"),
    )
    got = [tuple(r) for r in normalize(events).orderBy("seq").select(
        "command_line", "process_id", "destination_port", "destination_ip", "network_protocol", "parent_process").collect()]
    assert got == [("run", "7", None, None, "TCP", None), ("c2", "", 443, "1.1.1.1", "UDP", "p")]


def test_file_gate_and_route(spark):
    names = ["auth.log", "../../x/evil name.CSV", "a.exe", "noext", "b.zip", "c.json", "__.log", "system.LOG", "d.evtx"]
    frame = spark.createDataFrame([(i, n, 10) for i, n in enumerate(names)] + [(99, "e.txt", 0), (98, "f.txt", 600 << 20)], "id int, filename string, size long")
    got = {r["id"]: (r["clean_name"], r["reject_reason"], r["format"], r["evidence_type"])
           for r in evidence.route_format(evidence.file_gate(frame, max_bytes=500 << 20)).collect()}
    assert got[0] == ("auth.log", None, "syslog", "log")
    assert got[1] == ("evil_name.CSV", None, "csv", "csv")
    assert got[2][1] == "blocked_extension" and got[3][1] == "unsupported_extension"
    assert got[4][2:] == ("zip", "zip") and got[5][2] == "json" and got[7][2] == "text" and got[8][2] == "winevent"
    assert got[6][0] == ".log"
    assert got[99][1] == "empty_file" and got[98][1] == "too_large"
    assert evidence.file_gate(frame).where("id = 98").first()["accepted"]


def test_duplicates(spark):
    data = [(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 2, "a"), (5, 2, "c"), (6, 2, "c")]
    files = spark.createDataFrame(data, "evidence_id long, case_id long, sha256 string")
    stored = spark.createDataFrame([(2, "c")], "case_id long, sha256 string")
    flags = {r["evidence_id"]: r["is_duplicate"] for r in evidence.mark_duplicates(files, stored).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True}
    assert rows(evidence.dedupe_evidence(files, stored), "evidence_id") == [(1,), (3,), (4,)]


def test_stages(spark):
    files = spark.createDataFrame([(i, i % 10, "h" if i else None) for i in range(5)], "evidence_id long, case_id long, sha256 string")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "evidence_id long")
    cases = lambda *v: spark.createDataFrame([(x,) for x in v], "case_id long")
    got = evidence.stage_update(files, ids(2, 3, 4), ids(3, 4), cases(1, 4), cases(1, 4))
    assert rows(got, "evidence_id", "processing_stage") == [
        (0, "UPLOADED"), (1, "VERIFIED"), (2, "PARSED"), (3, "NORMALIZED"), (4, "CSP_VALIDATED"),
    ]


def test_custody(spark):
    log = spark.createDataFrame(
        [(i, 1 + i % 2, a, START + timedelta(hours=i)) for i, a in enumerate(["UPLOAD", "PARSE", "DELETE", "UPLOAD", "PARSE", "UPLOAD", "PARSE_FAIL"])],
        "log_id long, evidence_id long, action string, timestamp timestamp",
    )
    assert [r["log_id"] for r in evidence.custody_trail(log, 1).collect()] == [0, 2, 4, 6]
    feed = evidence.recent_activity(log).collect()
    assert feed[0]["details"] == {}
    told = log.withColumn("details", F.create_map(F.lit("rows"), F.col("log_id").cast("string")))
    assert evidence.recent_activity(told).first()["details"] == {"rows": "6"}
    assert [r["severity"] for r in feed] == ["critical", "info", "high", "info", "critical", "high"]
    assert feed[0]["action"] == "Action 'PARSE_FAIL' performed on Evidence #1"
    assert feed[0]["time"] == "2026-07-28 15:12 UTC"


def test_search(spark):
    frame = spark.createDataFrame([("50% off", "u"), ("500 off", None), ("x_y", "OFF")], "description string, user string")
    assert frame.where(like_any([F.col("description"), F.col("user")], "off")).count() == 3
    assert frame.where(like_any([F.col("description")], "50%")).count() == 2
    assert frame.where(like_any([F.col("description")], "50%", escape=True)).count() == 1
    assert frame.where(like_any([F.col("description")], "x_y", escape=True)).count() == 1
    cases = spark.createDataFrame([(1, "Alpha", 7, False), (2, "alphabet", 7, True), (3, "beta", 8, False)],
                                  "case_id long, title string, investigator_id long, is_deleted boolean")
    assert rows(search.case_title_search(cases, "ALPHA"), "case_id") == [(1,), (2,)]
    assert rows(timeline.owned(cases.select("case_id"), cases, 7)) == [(1,)]


def test_scores(spark):
    data = [("User", "x"), ("Malware", "y"), ("File", "z"), ("Host", "lateral-1"), ("Process", "exfil.exe"), ("Other", "Ransomware")]
    nodes = spark.createDataFrame([(1, str(i), t, n) for i, (t, n) in enumerate(data)], "case_id long, node_id string, node_type string, node_label string")
    got = rows(report.scored_nodes(nodes), "node_type", "severity", "category")
    assert got == sorted([
        ("User", "high", "Unauthorized Access"), ("Malware", "critical", "Malware Execution"), ("File", "medium", "Unknown Activity"),
        ("Host", "low", "Lateral Movement"), ("Process", "medium", "Data Exfiltration"), ("Other", "critical", "Unknown Activity"),
    ])
    assert rows(report.risk_score(nodes)) == [(1, 84, "critical", 74.8)]
    assert rows(report.highlights(nodes).where("kind = 'account'"), "value") == [("x",)]


def test_context(spark, sample):
    cases = spark.createDataFrame([(1, "T", "D", "high", "open"), (2, "U", None, "low", "open")], "case_id long, title string, description string, priority string, status string")
    files = spark.createDataFrame([(1, 1, "a.log", "log", 10, True, False), (2, 9, "z.log", "log", 10, True, False)], "evidence_id long, case_id long, original_filename string, file_type string, size long, is_parsed boolean, is_deleted boolean")
    nodes = spark.createDataFrame([(1, "Host", f"h{i:03d}") for i in range(60)], "case_id long, node_type string, node_label string")
    lines = report.case_context(cases, files, nodes, sample).orderBy("case_id", "section", "position").collect()
    one = [r["line"] for r in lines if r["case_id"] == 1]
    assert one[:6] == ["=== CASE METADATA ===", "Case ID: #1", "Title: T", "Description: D", "Priority: high", "Status: open"]
    assert one[6:8] == ["=== UPLOADED EVIDENCE ===", "- File: a.log (Type: log, Size: 10 bytes, Parsed: True)"]
    assert sum(x.startswith("- Entity") for x in one) == 50
    assert one[-7] == "[2026-07-28 09:12:01+00:00] [high] Failed Logon | User: Administrator | Host: DC-01 | Failed logon attempt from 192.168.1.105"
    assert {r["case_id"] for r in lines} == {1, 2}
    few = report.case_context(cases, files, nodes, sample, shown_nodes=3, shown_events=2).where("case_id = 1 AND position > 0")
    assert rows(few.where("section > 2").groupBy("section").count()) == [(3, 3), (4, 2)]
    two = [r["line"] for r in lines if r["case_id"] == 2]
    assert two[-2:] == ["=== EVIDENCE TIMELINE ===", "(No parsed events recorded yet in timeline)"]
    prompt = report.investigation_prompt(cases, detect.detect(sample, detect.detection_rules(spark)), sample)
    text = [r["line"] for r in prompt.where("case_id = 1").orderBy("section", "position").collect()]
    assert text[2] == "[CRITICAL] Audit log was cleared — potential cover-up — Rule: log_cleared"
    assert len(text) == 2 + 2 + 1 + 7

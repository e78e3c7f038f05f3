"""Evidence readers on small files."""

import json
import zipfile
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from casewise.functions.events import for_display
from casewise.functions.normalize import normalize
from casewise.operators.skew import spread_rows
from casewise.schemas import EVENT, EVENT_COLUMNS
from casewise.sources import archive, winevent_xml
from casewise.sources.archive import explode_archives, read_archive_events, skipped_members
from casewise.sources.csv_files import read_csv_events, read_mixed_csv_events
from casewise.sources.files import Origin, read_contents
from casewise.sources.ingest import READERS, read_evidence, register_reader
from casewise.sources.inventory import evidence_inventory
from casewise.sources.json_files import read_json_events
from casewise.sources.line_logs import read_syslog_events, read_text_events
from casewise.sources.winevent_xml import read_winevent_xml
from casewise.sources.xml_files import read_xml_events
from conftest import rows

HERE = Origin(case_id=1, evidence_id=5, ingest_ts="2026-01-02 03:04:05")
UTC = datetime

AUTH_LINES = """Aug  1 13:00:01 server01 sshd[1234]: Failed password for invalid user admin from 192.168.1.100 port 22 ssh2
Aug  1 13:05:00 server01 sshd[1234]: Accepted password for operator from 192.168.1.50 port 22 ssh2

Aug  1 13:05:12 server01 sudo: admin : TTY=pts/1 ; USER=root ; COMMAND=/bin/bash
Feb 30 13:10:45 server01 kernel: [12.7] USB 2-0: Mass storage device connected
something else entirely
"""

EVENT_BLOCK = """<Event xmlns="http://schemas.example.org/event">
  <System><Provider Name="Security-Auditing"/><EventID{q}>{id}</EventID><Level>2</Level><Channel>Security</Channel>
  <TimeCreated SystemTime="2026-03-01T10:00:00.5Z"/><Computer>DC-01.corp.local</Computer></System>
  <EventData><Data Name="SubjectUserName">boss</Data><Data Name="TargetUserName">target</Data>
  <Data Name="IpAddress">172.16.0.45</Data><Data Name="ProcessName">lsass.exe</Data></EventData>
</Event>"""


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_schema_of_every_reader(spark, tmp_path):
    path = write(tmp_path, "a.log", "x\n")
    df = read_text_events(spark, path, HERE)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in EVENT]


def test_syslog(spark, tmp_path):
    df = read_syslog_events(spark, write(tmp_path, "auth.log", AUTH_LINES), HERE, 2026).orderBy("seq")
    got = [tuple(r) for r in df.select("event_type", "severity", "user", "host", "ip_address", "event_id").collect()]
    assert got == [
        ("AuthFailure", "critical", "admin", "server01", "192.168.1.100", "sshd"),
        ("AuthSuccess", "high", "operator", "server01", "192.168.1.50", "sshd"),
        ("PrivilegeEscalation", "medium", "root", "server01", None, "sudo"),
        ("SyslogMessage", "low", "root", "server01", None, "kernel"),
        ("LogLine", "low", "UNKNOWN_USER", "UNKNOWN_HOST", None, None),
    ]
    times = [(r["timestamp"], r["ts_inferred"]) for r in df.collect()]
    assert times[0] == (datetime(2026, 8, 1, 13, 0, 1), False)
    # an impossible date keeps the row and takes the ingest time
    assert times[3] == (datetime(2026, 1, 2, 3, 4, 5), True)
    actions = [r["action"] for r in normalize(df).orderBy("seq").collect()]
    assert actions == ["AUTH_FAILURE", "AUTH_SUCCESS", "PRIVILEGE_ELEVATE", "USB_CONNECT", "GENERIC_EVENT"]


def test_syslog_descriptive(spark, tmp_path):
    df = read_syslog_events(spark, write(tmp_path, "auth.log", AUTH_LINES), HERE, 2026, "descriptive").orderBy("seq")
    got = [tuple(r) for r in df.select("event_type", "severity", "user", "is_suspicious").collect()]
    assert got == [
        ("SSH Login Failure", "high", "admin", True),
        ("SSH Login Success", "low", "operator", True),
        ("Sudo Command", "low", "UNKNOWN_USER", False),
        ("System Event", "low", "UNKNOWN_USER", False),
        ("Log Entry", "low", "UNKNOWN_USER", False),
    ]


def test_text_positions_grow_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * 200 for i in range(40_000)]
    path = write(tmp_path, "big.txt", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    spark.conf.set("spark.sql.files.openCostInBytes", "1048576")
    try:
        df = read_text_events(spark, path, HERE)
        assert df.rdd.getNumPartitions() > 1
        ordered = [r["description"].split()[1] for r in df.orderBy("seq").select("description").collect()]
        assert ordered == [str(i) for i in range(40_000)]
        assert df.select("event_uid").distinct().count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv(spark, tmp_path):
    text = (
        "timestamp,hostname,username,action,src_ip,severity,message\n"
        '2026-03-01T10:00:00Z,FS-01,CORP\\admin,LOGIN_FAILED,10.0.0.5,HIGH,"Failed, ""twice""\nover two lines"\n'
        "bad,,,,,WEIRD,\n"
    )
    df = read_csv_events(spark, write(tmp_path, "a.csv", text), HERE).orderBy("seq")
    first, second = df.collect()
    assert (first["host"], first["user"], first["ip_address"], first["severity"]) == ("FS-01", "CORP\\admin", "10.0.0.5", "high")
    assert first["description"] == 'Failed, "twice"\nover two lines'
    assert first["timestamp"] == datetime(2026, 3, 1, 10)
    assert (second["host"], second["event_type"], second["severity"], second["ts_inferred"]) == (
        "UNKNOWN_HOST", "CSVRecord", "low", True,
    )
    norm = normalize(df).orderBy("seq").first()
    assert (norm["domain"], norm["username"], norm["hostname"], norm["event_category"]) == (
        "CORP", "admin", "FS-01", "Authentication",
    )


def test_csv_with_different_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "host,user\nh1,u1\nh2,u2\n")
    write(tmp_path, "b [100%]+x.csv", "Message,Computer,Account\nhello,h3,u3\n")
    df = read_mixed_csv_events(spark, str(tmp_path), Origin(case_id=2))
    assert rows(df, "host", "user") == [("h1", "u1"), ("h2", "u2"), ("h3", "u3")]
    assert df.select("evidence_id").distinct().count() == 2


def test_csv_wide(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Time,Machine,subject,category,remote_ip,extra\n2026-01-01,m,s,,1.2.3.4,e\n")
    row = read_csv_events(spark, path, HERE, "wide").first()
    assert (row["host"], row["user"], row["ip_address"], row["event_type"]) == ("m", "s", "1.2.3.4", "LogEntry")
    assert row["description"].startswith("time=2026-01-01 | machine=m | subject=s | category=")
    assert row["source"] == "CSV Log" and row["timestamp"] == datetime(2026, 1, 1)


RECORDS = [
    {"Timestamp": "2026-03-01T10:00:00+02:00", "HOSTNAME": "DB-01", "username": "dba", "event_type": "SchemaChange",
     "severity": "critical", "nested": {"a": 1}},
    {"time": 17, "id": "E2", "message": "plain"},
]


def test_json_layouts(spark, tmp_path):
    write(tmp_path, "lines.json", json.dumps(RECORDS[0]) + "\nnot json\n" + json.dumps(RECORDS[1]) + ' x\n{"id":"E3"}]\n[1]\n')
    write(tmp_path, "array.json", json.dumps(RECORDS + [5], indent=1))
    write(tmp_path, "object.json", json.dumps(RECORDS[1], indent=2))
    write(tmp_path, "one_line.json", json.dumps(RECORDS))
    write(tmp_path, "broken.json", '[\n{"id": "B1"}\n{"id": "B2"}\n]')
    df = read_json_events(spark, str(tmp_path), Origin(case_id=1))
    got = rows(df.where(F.col("event_id").isNotNull() | (F.col("host") == "DB-01")), "host", "event_type", "event_id")
    assert got == sorted(
        [("DB-01", "SchemaChange", None)] * 3
        + [("UNKNOWN_HOST", "JsonLog", "E2")] * 3
        + [("UNKNOWN_HOST", "JsonLog", "B1"), ("UNKNOWN_HOST", "JsonLog", "B2")],
        key=repr,
    )
    assert df.count() == 8
    first = df.where("host = 'DB-01'").first()
    assert first["timestamp"] == datetime(2026, 3, 1, 8) and first["is_suspicious"]
    assert '"nested":{"a":1}' in first["description"]


def test_json_explicit_layouts_and_wide(spark, tmp_path):
    path = write(tmp_path, "a.json", json.dumps(RECORDS[0]) + "\n" + json.dumps(RECORDS[1]))
    assert read_json_events(spark, path, HERE, "lines").count() == 2
    whole = write(tmp_path, "b.json", json.dumps(RECORDS))
    assert read_json_events(spark, whole, HERE, "document").count() == 2
    wide = read_json_events(spark, path, HERE, "lines", "wide").orderBy("seq").collect()
    assert [r["event_type"] for r in wide] == ["SchemaChange", "JSON Event"]
    assert wide[1]["description"] == "plain"


def test_winevent_xml(spark, tmp_path):
    blocks = [
        EVENT_BLOCK.format(id="4625", q=' Qualifiers="0"'),
        "<Event><System></Broken></System></Event>",
        EVENT_BLOCK.format(id="9999", q=""),
        "<Event><System><EventID>1</EventID></System></Event>",
    ]
    write(tmp_path, "export.evtx", "<Events>" + "\n".join(blocks) + "</Events>")
    write(tmp_path, "plain.evtx", "first line\n\nsecond line\n")
    df = read_winevent_xml(spark, str(tmp_path), Origin(case_id=1))
    got = rows(df, "event_type", "severity", "host", "user", "ip_address", "process")
    assert got == sorted(
        [
            ("WinEvent_4625", "critical", "DC-01.corp.local", "target", "172.16.0.45", "lsass.exe"),
            ("WinEvent_9999", "low", "DC-01.corp.local", "target", "172.16.0.45", "lsass.exe"),
            ("WinEvent_1", "low", "LOCAL_HOST", "SYSTEM", None, None),
            ("WindowsLog", "low", "UNKNOWN_HOST", "UNKNOWN_USER", None, None),
            ("WindowsLog", "low", "UNKNOWN_HOST", "UNKNOWN_USER", None, None),
        ],
        key=repr,
    )
    first = df.where("event_id = '4625'").first()
    assert first["timestamp"] == datetime(2026, 3, 1, 10, 0, 0, 500000)
    assert first["description"] == "Windows Event Log ID 4625 on DC-01.corp.local"


def test_winevent_descriptive(spark, tmp_path):
    path = write(tmp_path, "export.xml", EVENT_BLOCK.format(id="4625", q=""))
    row = read_winevent_xml(spark, path, HERE, "descriptive").first()
    assert (row["event_type"], row["severity"], row["user"], row["source"]) == ("Failed Logon", "high", "boss", "Security")
    assert row["description"] == "Failed Logon — User: boss from 172.16.0.45"


XML = """<log xmlns="urn:x"><entry><Time>2026-01-01</Time><User>ann</User><host> </host><detail><code>7</code></detail></entry>
<entry><EventID>4</EventID></entry><empty/></log>"""


def test_xml(spark, tmp_path):
    write(tmp_path, "ok.xml", XML)
    write(tmp_path, "bad.xml", "<a><b>1</b>")
    df = read_xml_events(spark, str(tmp_path), Origin(case_id=1)).orderBy("seq")
    assert [r["event_type"] for r in df.collect()] == ["{urn:x}entry", "{urn:x}detail", "{urn:x}entry"]
    flat = read_xml_events(spark, str(tmp_path), Origin(case_id=1), "flat").orderBy("seq").collect()
    assert [(r["event_type"], r["user"], r["ts_inferred"]) for r in flat] == [
        ("{urn:x}entry", "ann", False), ("4", "UNKNOWN_USER", True), ("{urn:x}empty", "UNKNOWN_USER", True),
    ]
    assert flat[2]["description"] == "XML element {urn:x}empty"


def make_zip(path):
    inner = path.parent / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.log", "never seen")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("var/auth.log", AUTH_LINES)
        z.writestr("a.csv", "host,user\nh1,u1\n")
        z.writestr("b.json", json.dumps(RECORDS))
        z.writestr("c.txt", "one\ntwo\n")
        z.writestr("f.js", "var a\n")
        z.writestr("d.xml", XML)
        z.writestr("e.evtx", EVENT_BLOCK.format(id="4624", q=""))
        z.writestr("bad.exe", "MZ")
        z.write(inner, "inner.zip")
    inner.unlink()


def test_archive(spark, tmp_path):
    make_zip(tmp_path / "case.zip")
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    df = read_archive_events(spark, str(tmp_path), Origin(case_id=1), 2026)
    counts = dict((r["source"], r["count"]) for r in df.groupBy("source").count().collect())
    assert counts == {
        "LinuxSyslog": 4, "LinuxLog": 1, "CSVFile": 1, "JsonLog": 2, "TextLog": 3, "XmlLog": 3, "Security-Auditing": 1,
    }
    assert df.select("event_uid").distinct().count() == df.count()
    records = explode_archives(read_contents(spark, str(tmp_path), Origin(case_id=1)))
    skipped = {(r["path"].rsplit("/", 1)[-1], r["member"]) for r in skipped_members(records).collect()}
    assert skipped == {("case.zip", "bad.exe"), ("case.zip", "inner.zip"), ("broken.zip", "")}


def test_event_blocks_are_parsed_once(spark):
    """The filter on well-formed blocks used to parse each for itself."""
    pieces = spark.createDataFrame([(1, 1, 1, EVENT_BLOCK.format(id="4624", q="").split("</Event>")[0]), (1, 1, 2, "<Event><broken"), (1, 1, 3, "none")], "case_id long, evidence_id long, seq long, line string")
    blocks = winevent_xml.event_blocks(pieces)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert [(r["seq"], r["event"]["System"]["EventID"]) for r in blocks.collect()] == [(1, "4624")]


def test_small_archives_leave_a_task_together(tmp_path):
    """A batch for each archive took milliseconds; texts still leave before they are many."""
    make_zip(tmp_path / "a.zip")
    content = (tmp_path / "a.zip").read_bytes()
    names = ["case_id", "evidence_id", "path", "content"]
    batch = lambda ids: pa.RecordBatch.from_pydict(dict(zip(names, [[1] * len(ids), ids, [f"{i}.zip" for i in ids], [content] * len(ids)], strict=True)))
    single = pa.Table.from_batches(archive.exploded(iter([batch([1])])))
    together = list(archive.exploded(iter([batch([1, 2]), batch([3])])))
    assert len(together) == 1
    for i in (1, 2, 3):
        own = pa.Table.from_batches(together).to_pylist()
        assert [{**r, "evidence_id": 1, "path": "1.zip"} for r in own if r["evidence_id"] == i] == single.to_pylist()


def test_rows_that_take_long_are_dealt_over_tasks(spark):
    few = spread_rows(spark.range(10).coalesce(1), 100)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spread_rows(spark.range(100).coalesce(1), 10)
    assert many.rdd.getNumPartitions() == 10 and rows(many) == [(i,) for i in sorted(range(100), key=lambda i: repr((i,)))]


def test_whole_texts_of_any_length(spark, tmp_path):
    """No text is cut, neither a file's nor a field's, and files without a known suffix are read."""
    long = "m" * 5000
    write(tmp_path, "case_id=1/evidence_id=1/messages", f"first\n{long}\n")
    write(tmp_path, "case_id=1/evidence_id=2/data.odd", "x\n")
    write(tmp_path, "case_id=1/evidence_id=3/a.json", json.dumps({"message": long, "host": long}))
    write(tmp_path, "case_id=1/evidence_id=4/a.csv", f"message\n{long}\n")
    got = read_evidence(spark, str(tmp_path), Origin(), 2026)
    lengths = {(r["evidence_id"], r["n"]) for r in got.select("evidence_id", F.length("description").alias("n")).collect()}
    assert lengths == {(1, 5), (1, 5000), (2, 1), (3, 5000), (4, 5000)}
    assert rows(for_display(got.where("evidence_id = 3")).selectExpr("length(description)", "length(host)")) == [(500, 100)]


def test_evidence_folder_with_layout(spark, tmp_path):
    write(tmp_path, "case_id=1/evidence_id=11/auth.log", AUTH_LINES)
    write(tmp_path, "case_id=1/evidence_id=12/app.TXT", "hello\n")
    write(tmp_path, "case_id=2/evidence_id=21/events.json", json.dumps(RECORDS))
    write(tmp_path, "case_id=2/evidence_id=22/a.csv", "host,user\nh,u\n")
    write(tmp_path, "case_id=2/evidence_id=23/b.CSV", "message\nm\nn\n")
    write(tmp_path, "case_id=3/evidence_id=31/s.xml", XML)
    write(tmp_path, "case_id=3/evidence_id=32/w.evtx", EVENT_BLOCK.format(id="4624", q=""))
    (tmp_path / "case_id=3" / "evidence_id=33").mkdir()
    make_zip(tmp_path / "case_id=3" / "evidence_id=33" / "z.zip")
    df = read_evidence(spark, str(tmp_path), Origin(), 2026)
    counts = {(r["case_id"], r["evidence_id"]): r["count"] for r in df.groupBy("case_id", "evidence_id").count().collect()}
    assert counts == {
        (1, 11): 5, (1, 12): 1, (2, 21): 2, (2, 22): 1, (2, 23): 2, (3, 31): 3, (3, 32): 1, (3, 33): 15,
    }
    assert df.columns == EVENT_COLUMNS


def test_own_reader(spark, tmp_path):
    write(tmp_path, "a.special", "special\n")
    register_reader("*.special", lambda s, p, o, y: read_text_events(s, p, o, "*.special"))
    try:
        assert read_evidence(spark, str(tmp_path), HERE, 2026, ["*.special"]).count() == 1
    finally:
        READERS.pop("*.special")


def test_inventory(spark, tmp_path):
    import hashlib

    write(tmp_path, "a.log", "abc")
    row = evidence_inventory(spark, str(tmp_path)).first()
    assert (row["filename"], row["size"]) == ("a.log", 3)
    assert row["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert row["sha1"] == hashlib.sha1(b"abc").hexdigest()
    assert row["md5"] == hashlib.md5(b"abc").hexdigest()

"""Reader of ZIP archives: members are routed like files of their own."""

from __future__ import annotations

import csv
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.events import lower_keys
from casewise.session import materialize
from casewise.sources import csv_files, json_files, line_logs, winevent_xml, xml_files
from casewise.sources.files import Origin, read_contents

MEMBER_ROWS = "case_id long, evidence_id long, path string, member string, seq long, format string, tag string, line string"
# Records, and signs of text, that leave a task at a time.
CHUNK = 10_000
CHUNK_SIGNS = 8 << 20
_NAMES = ["case_id", "evidence_id", "path", "member", "seq", "format", "tag", "line"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def member_format(name: str) -> str | None:
    """Reader for a member, None for members that are skipped."""
    base = name.rsplit("/", 1)[-1].lower()
    extension = base.rsplit(".", 1)[-1] if "." in base else ""
    if not base or extension in X.ARCHIVE_SKIPPED_EXTENSIONS or extension == "zip":
        return None
    if extension in ("csv", "json", "xml"):
        return extension
    if extension == "evtx":
        return "winevent"
    hinted = any(hint in base for hint in X.SYSLOG_NAME_HINTS)
    return "syslog" if extension in X.LINE_LOG_EXTENSIONS and hinted else "text"


def _csv_rows(text: str) -> Iterator[tuple[str, str]]:
    for row in csv.DictReader(io.StringIO(text)):
        yield "", json.dumps({k: v for k, v in row.items() if k and v is not None})


def _json_rows(text: str) -> Iterator[tuple[str, str]]:
    try:
        value = json.loads(text)
        values = value if isinstance(value, list) else [value]
    except ValueError:
        values = []
        for line in text.splitlines():
            try:
                values.append(json.loads(line))
            except ValueError:
                continue
    return (("", json.dumps(v)) for v in values if isinstance(v, dict))


def _pieces(text: str) -> Iterator[tuple[str, str]]:
    parts = text.split(winevent_xml.END_TAG)
    if len(parts) == 1:
        return (("line", line) for line in text.splitlines())
    return (("block", part) for part in parts[:-1])


def member_rows(kind: str, content: bytes) -> Iterator[tuple[str, str]]:
    """(tag, text) of the records of one member; parsing into fields is left to Spark."""
    if kind == "xml":
        return ((tag, record) for _, tag, record in xml_files.elements_of(content, flat=False))
    text = content.decode("utf-8", errors="ignore")
    if kind == "csv":
        return _csv_rows(text)
    if kind == "json":
        return _json_rows(text)
    if kind == "winevent":
        return _pieces(text)
    return (("", line) for line in text.splitlines())


def members(content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, bytes, problem) of the members, one at a time; a member that is not read has a problem instead of bytes.

    A damaged archive ends with a row that has no name.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in sorted(archive.infolist(), key=lambda i: i.filename):
                if info.is_dir():
                    continue
                if not member_format(info.filename):
                    yield info.filename, None, "not read inside archives"
                    continue
                try:
                    yield info.filename, archive.read(info), None
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as problem:
                    yield info.filename, None, str(problem) or type(problem).__name__
    except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError) as problem:
        yield "", None, str(problem) or type(problem).__name__


def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member records of archives. Those of small archives leave together: a batch for each would cost far more than reading the archive."""
    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            seq = 0
            for name, content, problem in members(row["content"]):
                kind = "skipped" if problem else member_format(name)
                for tag, text in [("", problem)] if problem else member_rows(kind, content):
                    rows.append((row["case_id"], row["evidence_id"], row["path"], name, seq, kind, tag, text))
                    seq, size = seq + 1, size + len(text)
                    if len(rows) == CHUNK or size >= CHUNK_SIGNS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
                        rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def explode_archives(archives: DataFrame) -> DataFrame:
    """Records of all members of archives held as bytes; members that are not read have one row of format ``skipped``, with the reason as its line."""
    return archives.select("case_id", "evidence_id", "path", "content").mapInArrow(exploded, MEMBER_ROWS)


def skipped_members(records: DataFrame) -> DataFrame:
    """case_id, evidence_id, path, member and reason of what an archive holds and was not read."""
    return records.where(F.col("format") == "skipped").select(
        "case_id", "evidence_id", "path", "member", F.col("line").alias("reason")
    )


def archive_events(records: DataFrame, origin: Origin, year: int) -> DataFrame:
    """Events of exploded members, one branch per format."""

    def of(kind: str, tag: str | None = None) -> DataFrame:
        rows = records.where(F.col("format") == kind)
        return rows.where(F.col("tag") == tag) if tag else rows

    table = of("csv").withColumn("fields", lower_keys(F.from_json("line", "map<string,string>")))
    available = csv_files.map_fields(F.col("fields"), X.CSV_ALIASES)
    objects = of("json").withColumn("record", F.try_parse_json("line")).withColumn(
        "fields", F.try_variant_get("record", "$", "map<string,string>")
    )
    blocks = winevent_xml.event_blocks(of("winevent", "block"))
    parts = [
        csv_files.csv_events(table, available, F.col("line"), origin),
        json_files.json_events(objects, origin),
        winevent_xml.winevent_events(blocks, origin),
        winevent_xml.line_events(of("winevent", "line"), origin),
        xml_files.element_events(of("xml").withColumnRenamed("line", "record"), origin),
        line_logs.syslog_events(of("syslog"), origin, year),
        line_logs.text_events(of("text"), origin),
    ]
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    return events


def read_archive_events(
    spark: SparkSession, path, origin: Origin, year: int, glob: str | None = None
) -> DataFrame:
    """Events of all members of the ZIP files under the path.

    The exploded records are written once to the shared folder, since seven branches read them.
    """
    return archive_events(materialize(explode_archives(read_contents(spark, path, origin, glob))), origin, year)

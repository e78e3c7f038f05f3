"""Readers of syslog and plain text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions import syslog
from casewise.functions.events import universal_event
from casewise.functions.timestamps import syslog_time
from casewise.sources.files import Origin, read_lines


def _filled(lines: DataFrame) -> DataFrame:
    """Trimmed non-blank lines."""
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\r\n\f\x0b"))).where(F.col("line") != "")


def _raw(**fields):
    return F.to_variant_object(F.struct(*[c.alias(n) for n, c in fields.items()]))


def text_events(lines: DataFrame, origin: Origin) -> DataFrame:
    """Each non-blank line is one event."""
    rows = _filled(lines)
    fields = {
        "source": F.lit("TextLog"),
        "event_type": F.lit("LogLine"),
        "description": F.col("line"),
        "raw_data": _raw(line=F.col("line")),
    }
    return universal_event(rows, fields, origin.ingest_time())


def syslog_events(lines: DataFrame, origin: Origin, year: int, profile: str = "standard") -> DataFrame:
    """Syslog lines; lines of another form become plain ``LogLine`` events.

    ``profile="descriptive"`` uses the looser pattern with readable event names.
    """
    return {"standard": _standard, "descriptive": _descriptive}[profile](_filled(lines), origin, year)


def _standard(rows: DataFrame, origin: Origin, year: int) -> DataFrame:
    split = rows.withColumn("p", syslog.split_line(F.col("line")))
    split = split.withColumn("kind", syslog.message_class(F.col("p.message")))
    ok, message, kind = F.col("p.matched"), F.col("p.message"), F.col("kind")
    fields = {
        "timestamp": F.when(ok, syslog_time(F.col("p.month"), F.col("p.day"), F.col("p.clock"), year)),
        "host": F.when(ok, F.col("p.host")),
        "user": F.when(ok, syslog.message_user(kind, message)),
        "event_type": F.when(ok, syslog.class_event_type(kind)).otherwise("LogLine"),
        "event_id": F.when(ok, F.col("p.process")),
        "severity": F.when(ok, syslog.class_severity(kind)).otherwise("low"),
        "source": F.when(ok, "LinuxSyslog").otherwise("LinuxLog"),
        "ip_address": F.when(ok, syslog.message_address(kind, message)),
        "process": F.when(ok, F.col("p.process")),
        "description": F.when(ok, message).otherwise(F.col("line")),
        "raw_data": _raw(raw_line=F.col("line")),
    }
    return universal_event(split, fields, origin.ingest_time())


def _descriptive(rows: DataFrame, origin: Origin, year: int) -> DataFrame:
    split = rows.withColumn("p", syslog.split_line(F.col("line"), X.SYSLOG_LINE_LOOSE))
    ok, message = F.col("p.matched"), F.col("p.message")
    fields = {
        "timestamp": F.when(ok, syslog_time(F.col("p.month"), F.col("p.day"), F.col("p.clock"), year)),
        "host": F.when(ok, F.col("p.host")),
        "user": F.when(ok, syslog.descriptive_user(message)),
        "event_type": F.when(ok, syslog.descriptive_event_type(F.col("p.process"), message)).otherwise("Log Entry"),
        "severity": F.when(ok, syslog.descriptive_severity(message)).otherwise("low"),
        "source": F.when(ok, "Linux Syslog").otherwise("Linux Log"),
        "process": F.when(ok, F.col("p.process")),
        "description": F.when(ok, message).otherwise(F.col("line")),
        "raw_data": _raw(line=F.col("line"), pid=F.when(ok, F.col("p.pid"))),
    }
    suspicious = F.when(ok, syslog.descriptive_suspicion(message)).otherwise(False)
    return universal_event(split, fields, origin.ingest_time(), suspicious)


def read_text_events(spark: SparkSession, path, origin: Origin, glob: str | None = None) -> DataFrame:
    return text_events(read_lines(spark, path, origin, glob), origin)


def read_syslog_events(
    spark: SparkSession, path, origin: Origin, year: int, profile: str = "standard", glob: str | None = None
) -> DataFrame:
    return syslog_events(read_lines(spark, path, origin, glob), origin, year, profile)

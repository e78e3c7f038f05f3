"""Reader of exported Windows event XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions import winevent
from casewise.functions.events import universal_event
from casewise.functions.text import first_present, present
from casewise.functions.timestamps import iso_to_utc
from casewise.operators.skew import broadcast_if_small
from casewise.session import materialize
from casewise.sources.files import Origin, read_lines

END_TAG = "</Event>"
BLOCK = r"(?s)<Event[\s>].*"

EVENT_XML = (
    "System struct<Provider: struct<_Name: string>, EventID: string, Level: string, Channel: string, "
    "Computer: string, TimeCreated: struct<_SystemTime: string>>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>, "
    "UserData struct<Data: array<struct<_Name: string, _VALUE: string>>>, "
    "broken string"
)


def event_blocks(pieces: DataFrame) -> DataFrame:
    """Well-formed event blocks among pieces of text that each end before an event's end tag."""
    block = F.regexp_extract("line", BLOCK, 0)
    # Attributes of EventID would turn its text into a structure.
    plain = F.regexp_replace("xml", r"<EventID\s[^>]*>", "<EventID>")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreSurroundingSpaces": "false"}
    return (
        pieces.withColumn("__block", block)
        .where(F.col("__block") != "")
        .withColumn("xml", F.concat("__block", F.lit(END_TAG)))
        # As a generated row the event is parsed once; the filter would otherwise parse it for itself.
        .withColumn("event", F.explode(F.array(F.from_xml(plain, EVENT_XML, options))))
        .where(F.col("event.broken").isNull() & F.col("event").isNotNull())
        .drop("line", "__block")
        .withColumn(
            "data",
            F.transform(
                F.filter(
                    F.concat(
                        F.coalesce("event.EventData.Data", F.array().cast("array<struct<_Name: string, _VALUE: string>>")),
                        F.coalesce("event.UserData.Data", F.array().cast("array<struct<_Name: string, _VALUE: string>>")),
                    ),
                    lambda d: present(d["_Name"]).isNotNull(),
                ),
                lambda d: F.struct(d["_Name"].alias("name"), F.coalesce(d["_VALUE"], F.lit("")).alias("value")),
            ),
        )
    )


def winevent_events(blocks: DataFrame, origin: Origin, profile: str = "standard") -> DataFrame:
    """Events from blocks; ``profile="descriptive"`` gives readable names and level severities."""
    rows = blocks.select(
        "case_id",
        "evidence_id",
        "seq",
        "xml",
        "data",
        F.trim("event.System.EventID").alias("number"),
        F.col("event.System.Provider._Name").alias("provider"),
        F.trim("event.System.Level").alias("level"),
        F.trim("event.System.Channel").alias("channel"),
        F.trim("event.System.Computer").alias("computer"),
        iso_to_utc(F.col("event.System.TimeCreated._SystemTime")).alias("created"),
    ).withColumn("number", present(F.col("number")))
    data, number = F.col("data"), F.col("number")
    pairs = F.map_from_entries(data)
    if profile == "standard":
        computer = first_present([F.col("computer")], "LOCAL_HOST")
        fields = {
            "timestamp": F.col("created"),
            "host": computer,
            "user": winevent.data_user(data),
            "event_type": F.coalesce(F.concat(F.lit("WinEvent_"), number), F.lit("WindowsEvent")),
            "event_id": number,
            "severity": winevent.id_severity(number),
            "source": first_present([F.col("provider")], "Security"),
            "ip_address": winevent.data_address(data),
            "process": winevent.data_process(data),
            "description": F.concat(
                F.lit("Windows Event Log ID "), F.coalesce(number, F.lit("None")), F.lit(" on "), computer
            ),
            "raw_data": F.parse_json(
                F.to_json(F.struct(F.col("xml"), pairs.alias("data")))
            ),
        }
    else:
        fields = {
            "timestamp": F.col("created"),
            "host": F.col("computer"),
            "user": first_present(
                [winevent.named_data_value(data, "SubjectUserName"), winevent.named_data_value(data, "TargetUserName")]
            ),
            "event_type": winevent.event_name(number),
            "event_id": number,
            "severity": winevent.level_severity(F.col("level")),
            "source": first_present([F.col("channel")], "Windows"),
            "ip_address": winevent.named_data_value(data, "IpAddress"),
            "process": first_present(
                [winevent.named_data_value(data, "NewProcessName"), winevent.named_data_value(data, "ProcessName")]
            ),
            "description": winevent.event_description(number, data),
            "raw_data": F.parse_json(F.to_json(pairs)),
        }
    return universal_event(rows, fields, origin.ingest_time())


def line_events(lines: DataFrame, origin: Origin) -> DataFrame:
    """Lines of files that hold no event block."""
    fields = {
        "source": F.lit("WindowsEVTX"),
        "event_type": F.lit("WindowsLog"),
        "description": F.col("line"),
        "raw_data": F.parse_json(F.to_json(F.struct(F.col("line").alias("raw_line")))),
    }
    return universal_event(lines.where(F.trim("line") != ""), fields, origin.ingest_time())


def read_winevent_xml(
    spark: SparkSession,
    path,
    origin: Origin,
    profile: str = "standard",
    glob: str | None = None,
    plain_lines: bool = True,
) -> DataFrame:
    """Every event block of the files. Text is cut at the end tags, so large files are split.

    With ``plain_lines`` a file without any block gives one event per line; finding such files
    costs another pass, so turn it off for exports known to be XML.
    """
    pieces = read_lines(spark, path, origin, glob, separator=END_TAG)
    events = winevent_events(event_blocks(pieces), origin, profile)
    if not plain_lines or profile != "standard":
        return events
    # Stored, since they are counted before they are joined, and each time would read all files.
    with_blocks = materialize(pieces.where(F.col("line").rlike(r"<Event[\s>]")).select("path").distinct(), "with-blocks")
    others = read_lines(spark, path, origin, glob).join(broadcast_if_small(with_blocks), "path", "left_anti")
    return events.unionByName(line_events(others, origin))

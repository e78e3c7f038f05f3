"""The universal event record that every reader produces."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions.text import cut, first_present, present
from casewise.schemas import EVENT_COLUMNS
from casewise.taxonomy import (
    ALERT_SEVERITIES,
    DESCRIPTION_LIMIT,
    FIELD_LIMITS,
    PARSED_CONFIDENCE,
    PARSED_CONFIDENCE_OTHERWISE,
    SEVERITIES,
)

TEXT_FIELDS = [
    "source", "event_type", "event_id", "user", "host", "ip_address",
    "process", "file_path", "severity", "description",
]


def event_key(evidence_id: Column, seq: Column) -> Column:
    """Stable id of an event: the same file position gives the same id."""
    return F.sha2(F.concat_ws("|", evidence_id.cast("string"), seq.cast("string")), 256)


def clamp_severity(severity: Column) -> Column:
    lowered = F.lower(first_present([severity], "low"))
    return F.when(lowered.isin(SEVERITIES), lowered).otherwise("low")


def parsed_confidence(severity: Column) -> Column:
    score = F.lit(PARSED_CONFIDENCE_OTHERWISE)
    for name, value in PARSED_CONFIDENCE.items():
        score = F.when(severity == name, value).otherwise(score)
    return score


def universal_event(
    rows: DataFrame,
    fields: Mapping[str, Column],
    ingest_ts: Column,
    is_suspicious: Column | None = None,
) -> DataFrame:
    """Fill defaults, cut long text, clamp the severity and add suspicion and confidence.

    ``fields`` maps the text fields plus ``timestamp`` and ``raw_data`` to columns;
    ``rows`` must carry ``case_id``, ``evidence_id`` and ``seq``.
    """
    null = F.lit(None).cast("string")
    value = {name: fields.get(name, null) for name in TEXT_FIELDS}
    staged = rows.select(
        "case_id",
        "evidence_id",
        "seq",
        fields.get("timestamp", F.lit(None).cast("timestamp")).alias("__ts"),
        fields.get("raw_data", F.parse_json(F.lit("{}"))).alias("raw_data"),
        (is_suspicious if is_suspicious is not None else F.lit(None).cast("boolean")).alias("__suspicious"),
        *[value[name].alias(name) for name in TEXT_FIELDS if name != "severity"],
        clamp_severity(value["severity"]).alias("severity"),
    )
    defaults = {
        "host": "UNKNOWN_HOST",
        "user": "UNKNOWN_USER",
        "event_type": "LogEntry",
        "source": "System",
    }
    finished = {name: first_present([F.col(name)], defaults.get(name)) for name in FIELD_LIMITS}
    return staged.select(
        event_key(F.col("evidence_id"), F.col("seq")).alias("event_uid"),
        F.col("evidence_id").cast("long").alias("evidence_id"),
        F.col("case_id").cast("long").alias("case_id"),
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("__ts"), ingest_ts).alias("timestamp"),
        F.col("__ts").isNull().alias("ts_inferred"),
        *[column.alias(name) for name, column in finished.items()],
        F.col("severity"),
        F.coalesce(
            present(F.col("description")),
            F.concat(F.lit("Parsed event from "), F.coalesce(F.col("source"), F.lit("None"))),
        ).alias("description"),
        F.col("raw_data"),
        F.coalesce(F.col("__suspicious"), F.col("severity").isin(ALERT_SEVERITIES)).alias("is_suspicious"),
        parsed_confidence(F.col("severity")).alias("confidence_score"),
    ).select(*EVENT_COLUMNS)


def for_display(events: DataFrame, limits: Mapping[str, int] = FIELD_LIMITS, description: int = DESCRIPTION_LIMIT) -> DataFrame:
    """The events with their texts cut to the given lengths; the tables themselves hold whole texts."""
    return events.withColumns({name: cut(F.col(name), limit) for name, limit in {**limits, "description": description}.items()})


def pick_alias(available: Mapping[str, Column], names: list[str], otherwise: str | None = None) -> Column:
    """First non-empty of the named fields; ``available`` has lower-case keys."""
    return first_present([available[n] for n in names if n in available], otherwise)


def pick_from_map(fields: Column, names: list[str], otherwise: str | None = None) -> Column:
    """First non-empty of the named keys of a ``map<string,string>`` with lower-case keys."""
    return first_present([fields.getItem(n) for n in names], otherwise)


def lower_keys(fields: Column) -> Column:
    """Lower-case the keys of a map; of equal keys the last one wins."""
    return F.transform_keys(fields, lambda key, _: F.lower(key))

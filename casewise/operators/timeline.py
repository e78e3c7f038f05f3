"""Timelines of a case."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.ranking import number_rows, page
from casewise.operators.search import live, suspicious
from casewise.operators.skew import lookup


def build_timeline(events: DataFrame) -> DataFrame:
    """Number the events of each case by time from 1; unknown times come first."""
    order = [F.col("timestamp").asc_nulls_first(), F.col("seq").asc(), F.col("event_uid").asc()]
    return number_rows(events, ["case_id"], order, "sequence_id")


def case_events(events: DataFrame, evidence: DataFrame, exclude_deleted: bool = False) -> DataFrame:
    """Events joined to their evidence file; the case is the one of the evidence row.

    One evidence file may hold a large share of all events, hence the skew-safe lookup.
    """
    files = live(evidence) if exclude_deleted else evidence
    table = files.select("evidence_id", F.col("case_id").alias("__case"))
    joined = lookup(events.drop("case_id"), table, ["evidence_id"])
    return joined.where(F.col("__case").isNotNull()).withColumnRenamed("__case", "case_id")


def timeline_range(
    events: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Both ends are inclusive; the comparison reaches the file scan."""
    rows = events
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    return rows


def timeline_page(events: DataFrame, case_id: int, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a case in time order."""
    rows = events.where(F.col("case_id") == case_id)
    return page(rows, [F.col("timestamp"), F.col("event_uid")], skip, limit)


def suspicious_ranked(events: DataFrame) -> DataFrame:
    """Suspicious events, most certain first, then by time."""
    return suspicious(events).orderBy(
        F.col("confidence_score").desc(), F.col("timestamp").asc(), F.col("event_uid").asc()
    )


def owned(df: DataFrame, cases: DataFrame, investigator_id: int) -> DataFrame:
    """Rows whose case is live and belongs to the investigator."""
    mine = live(cases).where(F.col("investigator_id") == investigator_id).select("case_id")
    return df.join(mine, "case_id", "left_semi")


def reports_of_owner(reports: DataFrame, cases: DataFrame, investigator_id: int) -> DataFrame:
    """Reports with the title of their case, for the owner of the case only, newest first."""
    mine = cases.where(F.col("investigator_id") == investigator_id).select("case_id", "title")
    return reports.join(mine, "case_id").orderBy(F.col("created_at").desc(), F.col("report_id").asc())

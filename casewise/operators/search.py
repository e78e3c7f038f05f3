"""Filters over events, cases, evidence and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions.text import like_any
from casewise.taxonomy import ALERT_SEVERITIES


def _equal(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def _matching(df: DataFrame, columns: list[str], search: str | None, escape: bool) -> DataFrame:
    return df.where(like_any([F.col(c) for c in columns], search, escape)) if search else df


def search_events(
    events: DataFrame,
    case_id: int | None = None,
    severity: str | None = None,
    search: str | None = None,
    escape: bool = False,
) -> DataFrame:
    rows = _equal(events, case_id=case_id, severity=severity)
    return _matching(rows, ["description", "user", "host", "process", "ip_address"], search, escape)


def search_normalized(
    normalized: DataFrame,
    case_id: int | None = None,
    category: str | None = None,
    severity: str | None = None,
    search: str | None = None,
    escape: bool = False,
) -> DataFrame:
    rows = _equal(normalized, case_id=case_id, event_category=category, severity=severity)
    return _matching(rows, ["action", "username", "hostname", "ip_address", "process_name"], search, escape)


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(~F.col("is_deleted"))


def search_cases(
    cases: DataFrame,
    investigator_id: int,
    status: str | None = None,
    priority: str | None = None,
    search: str | None = None,
    escape: bool = False,
) -> DataFrame:
    rows = _equal(live(cases), investigator_id=investigator_id, status=status, priority=priority)
    return _matching(rows, ["title", "description"], search, escape)


def search_evidence(
    evidence: DataFrame,
    case_id: int | None = None,
    file_type: str | None = None,
    search: str | None = None,
    escape: bool = False,
) -> DataFrame:
    rows = _equal(live(evidence), case_id=case_id, file_type=file_type)
    return _matching(rows, ["filename", "original_filename", "sha256"], search, escape)


def nodes_of_type(nodes: DataFrame, node_type: str, case_id: int | None = None) -> DataFrame:
    return _equal(nodes, node_type=node_type, case_id=case_id)


def edges_of_type(edges: DataFrame, edge_type: str, case_id: int | None = None) -> DataFrame:
    return _equal(edges, edge_type=edge_type, case_id=case_id)


def suspicious(events: DataFrame) -> DataFrame:
    return events.where(F.col("is_suspicious"))


def active_alerts(events: DataFrame) -> DataFrame:
    return events.where(F.col("severity").isin(ALERT_SEVERITIES))


def _holds(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.lower(F.col(column)).contains(text.lower()), F.lit(False))
    return df.where(hit)


def timeline_keyword(events: DataFrame, text: str) -> DataFrame:
    return _holds(events, ["event_type", "user", "host"], text) if text else events


def case_title_search(cases: DataFrame, text: str) -> DataFrame:
    return _holds(cases, ["title"], text)


def node_search(nodes: DataFrame, text: str = "", node_type: str | None = None) -> DataFrame:
    rows = _equal(nodes, node_type=node_type)
    return _holds(rows, ["node_label", "node_type"], text) if text else rows

"""Weights, heuristics, risk scores and text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.text import contains_any, first_present
from casewise.functions.timestamps import utc_text


def edge_weight(severity: Column, confidence: Column) -> Column:
    """1 / (confidence in [.1, 1] x severity multiplier), three decimals; missing confidence is .8."""
    multiplier = F.lit(1.0)
    for name, value in X.WEIGHT_MULTIPLIER.items():
        multiplier = F.when(severity == name, value).otherwise(multiplier)
    known = F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(X.NORMALIZED_CONFIDENCE_DEFAULT))
    bounded = F.greatest(F.lit(0.1), F.least(F.lit(1.0), known))
    return F.round(F.lit(1.0) / (bounded * multiplier), 3)


def step_cost(weight: Column) -> Column:
    """Cost of walking an edge: a missing weight is 1, and no step is below the minimum."""
    return F.greatest(F.lit(X.MIN_STEP_COST), F.coalesce(weight.cast("double"), F.lit(1.0)))


def user_label(domain: Column, username: Column) -> Column:
    name = first_present([username], "UNKNOWN_USER")
    return F.when(
        F.coalesce(domain, F.lit("")) != "", F.concat(domain, F.lit("\\"), name)
    ).otherwise(name)


def event_label(event_uid: Column) -> Column:
    return F.concat(F.lit("Event_"), event_uid)


def evidence_label(evidence_id: Column) -> Column:
    return F.concat(F.lit("Evidence_"), evidence_id.cast("string"))


def privilege_gap(label: Column, goal: Column, level: Column, goal_level: Column) -> Column:
    """Half the privilege still to be gained; 0 at the goal; a missing level is 1."""
    one = F.lit(1.0)
    gap = F.coalesce(goal_level.cast("double"), one) - F.coalesce(level.cast("double"), one)
    return F.when(label == goal, 0.0).otherwise(F.greatest(F.lit(0.0), gap) * 0.5)


def zero_heuristic(label: Column, goal: Column, level: Column, goal_level: Column) -> Column:
    return F.lit(0.0)


def node_severity(node_type: Column, label: Column) -> Column:
    t, n = F.lower(F.coalesce(node_type, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(contains_any(t, ["malware", "exploit"]) | n.contains("ransomware"), "critical")
        .when(contains_any(t, ["user", "cmd"]) | contains_any(n, ["admin", "privilege"]), "high")
        .when(contains_any(t, ["file", "process"]) | n.contains("scan"), "medium")
        .otherwise("low")
    )


def node_category(node_type: Column, label: Column) -> Column:
    t, n = F.lower(F.coalesce(node_type, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(n.contains("lateral"), "Lateral Movement")
        .when(contains_any(n, ["privilege", "escalat"]), "Privilege Escalation")
        .when(n.contains("exfil"), "Data Exfiltration")
        .when(t.contains("malware"), "Malware Execution")
        .when(contains_any(t, ["user", "credential"]), "Unauthorized Access")
        .when(contains_any(t, ["process", "cmd"]), "Process Execution")
        .when(contains_any(t, ["host", "server"]), "Host Compromise")
        .otherwise("Unknown Activity")
    )


def risk_points(severity: Column) -> Column:
    points = F.lit(0)
    for name, value in X.RISK_WEIGHTS.items():
        points = F.when(severity == name, value).otherwise(points)
    return points


def risk_band(score: Column) -> Column:
    band = F.lit("low")
    for floor, name in reversed(X.RISK_BANDS):
        band = F.when(score >= floor, name).otherwise(band)
    return band


def plausibility(validation_score: Column, risk: Column) -> Column:
    """The validation score where one exists, else 100 - 0.3 x risk; 0 without risk."""
    derived = F.when(risk > 0, F.round(F.lit(100.0) - risk * 0.3, 1)).otherwise(0.0)
    return F.coalesce(validation_score, derived)


def activity_severity(action: Column) -> Column:
    return (
        F.when(action.isin("DELETE", "PARSE_FAIL"), "critical").when(action == "PARSE", "high").otherwise("info")
    )


def activity_text(action: Column, evidence_id: Column) -> Column:
    return F.concat(
        F.lit("Action '"), action, F.lit("' performed on Evidence #"), evidence_id.cast("string")
    )


def activity_time(timestamp: Column) -> Column:
    return F.coalesce(F.date_format(timestamp, "yyyy-MM-dd HH:mm 'UTC'"), F.lit("Recently"))


# ---- one text line per record -----------------------------------------------------


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def event_line() -> Column:
    return F.concat(
        F.lit("["), _text(utc_text(F.col("timestamp"))), F.lit("] ["), _text(F.col("severity")), F.lit("] "),
        _text(F.col("event_type")), F.lit(" | User: "), _text(F.col("user")), F.lit(" | Host: "),
        _text(F.col("host")), F.lit(" | "), _text(F.col("description")),
    )


def prompt_event_line() -> Column:
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("N/A"))

    return F.concat(
        F.lit("["), _text(utc_text(F.col("timestamp"))), F.lit("] "), _text(F.col("event_type")), F.lit(" | User: "),
        known("user"), F.lit(" | Host: "), known("host"), F.lit(" | IP: "), known("ip_address"), F.lit(" | "),
        _text(F.col("description")),
    )


def node_line() -> Column:
    return F.concat(F.lit("- Entity ["), F.col("node_type"), F.lit("]: "), F.col("node_label"))


def alert_line() -> Column:
    return F.concat(
        F.lit("["), F.upper(F.coalesce(F.col("severity"), F.lit("HIGH"))), F.lit("] "), _text(F.col("title")),
        F.lit(" — Rule: "), _text(F.col("rule_name")),
    )


def evidence_line() -> Column:
    return F.concat(
        F.lit("- File: "), _text(F.col("original_filename")), F.lit(" (Type: "), _text(F.col("file_type")),
        F.lit(", Size: "), _text(F.col("size")), F.lit(" bytes, Parsed: "),
        F.when(F.col("is_parsed"), "True").otherwise("False"), F.lit(")"),
    )

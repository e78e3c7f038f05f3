"""Dashboards, risk scores and text context of cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewise.functions.scoring import (
    alert_line,
    event_line,
    evidence_line,
    node_category,
    node_line,
    node_severity,
    plausibility,
    prompt_event_line,
    risk_band,
    risk_points,
)
from casewise.operators.ranking import number_rows, top_per_group
from casewise.operators.search import active_alerts, live

CONTEXT_NODES = 50
CONTEXT_EVENTS = 200
PROMPT_EVENTS = 150
SECTIONS = [
    "CASE METADATA",
    "UPLOADED EVIDENCE",
    "KNOWLEDGE GRAPH ENTITIES",
    "EVIDENCE TIMELINE",
]


def dashboard_stats(cases: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """One row of counts: live cases and evidence, high or critical events, parsed evidence."""
    kept = live(evidence)
    counted = {
        "total_cases": live(cases),
        "total_evidence": kept,
        "active_alerts": active_alerts(events),
        "timelines_built": kept.where(F.col("is_parsed")),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counted.items()]
    stacked = reduce(DataFrame.unionByName, rows)
    return stacked.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counted])


def scored_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "case_id",
        "node_id",
        "node_type",
        "node_label",
        node_severity(F.col("node_type"), F.col("node_label")).alias("severity"),
        node_category(F.col("node_type"), F.col("node_label")).alias("category"),
    )


def risk_score(nodes: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Risk score 0..100, its band, and the plausibility of each case."""
    total = F.sum(risk_points(F.col("severity")))
    scored = scored_nodes(nodes).groupBy("case_id").agg(F.least(total, F.lit(100)).cast("long").alias("risk_score"))
    if validation is not None:
        scored = scored.join(validation.select("case_id", "validation_score"), "case_id", "left")
    else:
        scored = scored.withColumn("validation_score", F.lit(None).cast("double"))
    return scored.select(
        "case_id",
        "risk_score",
        risk_band(F.col("risk_score")).alias("risk_level"),
        plausibility(F.col("validation_score"), F.col("risk_score")).alias("plausibility"),
    )


def highlights(nodes: DataFrame, threats_shown: int = 4, names_shown: int = 3) -> DataFrame:
    """First distinct values of a case in alphabetic order, in rows: so many threats, and so many accounts and hosts each."""
    kind = F.lower(F.coalesce("node_type", F.lit("")))
    scored = scored_nodes(nodes)
    threats = scored.where(F.col("category") != "Unknown Activity").select(
        "case_id",
        F.lit("threat").alias("kind"),
        F.upper(F.replace("category", F.lit(" "), F.lit("_"))).alias("value"),
    )
    accounts = scored.where(kind.contains("user")).select(
        "case_id", F.lit("account").alias("kind"), F.col("node_label").alias("value")
    )
    hosts = scored.where(kind.contains("host") | kind.contains("server")).select(
        "case_id", F.lit("host").alias("kind"), F.col("node_label").alias("value")
    )
    values = threats.unionByName(accounts).unionByName(hosts).distinct()
    ranked = top_per_group(values, ["case_id", "kind"], [F.col("value")], max(threats_shown, names_shown), "position")
    return ranked.where(F.col("position") <= F.when(F.col("kind") == "threat", threats_shown).otherwise(names_shown))


def _lines(df: DataFrame, section: int, position, line) -> DataFrame:
    return df.select(
        "case_id", F.lit(section).alias("section"), position.cast("long").alias("position"), line.alias("line")
    )


def case_context(
    cases: DataFrame,
    evidence: DataFrame,
    nodes: DataFrame,
    events: DataFrame,
    shown_nodes: int = CONTEXT_NODES,
    shown_events: int = CONTEXT_EVENTS,
) -> DataFrame:
    """Context of every case as ordered text lines (section, position, line).

    Sections: case metadata, all live evidence files, the first ``shown_nodes`` nodes by type and
    label, the first ``shown_events`` events by time; only of cases that ``cases`` holds. The number of
    evidence files of a case has no bound, so the text stays in rows; order by (section,
    position) and join with line breaks to print it.
    """
    known = cases.select("case_id").distinct()
    evidence, nodes, events = (df.join(known, "case_id", "left_semi") for df in (live(evidence), nodes, events))
    about = F.array(
        F.concat(F.lit("Case ID: #"), F.col("case_id").cast("string")),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit("None"))),
        F.concat(F.lit("Description: "), F.coalesce("description", F.lit("None"))),
        F.concat(F.lit("Priority: "), F.coalesce("priority", F.lit("None"))),
        F.concat(F.lit("Status: "), F.coalesce("status", F.lit("None"))),
    )
    metadata = cases.select("case_id", F.posexplode(about).alias("p", "text"))
    files = number_rows(
        evidence.withColumn("text", evidence_line()).select("case_id", "evidence_id", "text"),
        ["case_id"],
        [F.col("evidence_id")],
        "n",
    )
    entities = top_per_group(
        nodes.select("case_id", "node_type", "node_label"),
        ["case_id"],
        [F.col("node_type"), F.col("node_label")],
        shown_nodes,
        "n",
        dealt=True,
    ).withColumn("text", node_line())
    timeline = top_per_group(
        events.select("case_id", "timestamp", "event_uid", "severity", "event_type", "user", "host", "description"),
        ["case_id"],
        [F.col("timestamp").asc_nulls_first(), F.col("event_uid")],
        shown_events,
        "n",
        dealt=True,
    ).withColumn("text", event_line())
    silent = cases.join(events.select("case_id").distinct(), "case_id", "left_anti")
    parts = [
        _lines(metadata, 1, F.col("p") + 1, F.col("text")),
        _lines(files, 2, F.col("n"), F.col("text")),
        _lines(entities, 3, F.col("n"), F.col("text")),
        _lines(timeline, 4, F.col("n"), F.col("text")),
        _lines(silent, 4, F.lit(1), F.lit("(No parsed events recorded yet in timeline)")),
    ]
    lines = reduce(DataFrame.unionByName, parts)
    always = cases.select("case_id", F.explode(F.array(F.lit(1), F.lit(4))).alias("section"))
    filled = [df.select("case_id", F.lit(k).alias("section")).distinct() for k, df in ((2, evidence), (3, nodes))]
    heads = reduce(DataFrame.unionByName, [always, *filled])
    titles = F.array(*[F.lit(f"=== {name} ===") for name in SECTIONS])
    return lines.unionByName(_lines_of_heads(heads, titles))


def _lines_of_heads(heads: DataFrame, titles) -> DataFrame:
    return heads.select(
        "case_id", "section", F.lit(0).cast("long").alias("position"), F.element_at(titles, F.col("section")).alias("line")
    )


def investigation_prompt(cases: DataFrame, alerts: DataFrame, events: DataFrame, shown_events: int = PROMPT_EVENTS) -> DataFrame:
    """Prompt text of every case as ordered lines: title, alerts, then the first ``shown_events`` events by time."""
    head = cases.select(
        "case_id",
        F.posexplode(
            F.array(
                F.concat(F.lit("=== CASE INVESTIGATION: "), F.coalesce("title", F.lit("None")), F.lit(" ===")),
                F.lit("--- ALERTS ---"),
            )
        ).alias("p", "text"),
    )
    # A case has at most one alert per rule of the catalogue, so its window is short.
    by_rule = Window.partitionBy("case_id").orderBy("rule_name")
    listed = alerts.withColumn("n", F.row_number().over(by_rule)).withColumn("text", alert_line())
    middle = cases.select("case_id", F.lit("--- CHRONOLOGICAL TIMELINE ---").alias("text"))
    timeline = top_per_group(
        events.select("case_id", "timestamp", "event_uid", "event_type", "user", "host", "ip_address", "description"),
        ["case_id"],
        [F.col("timestamp").asc_nulls_first(), F.col("event_uid")],
        shown_events,
        "n",
        dealt=True,
    ).withColumn("text", prompt_event_line())
    parts = [
        _lines(head, 1, F.col("p") + 1, F.col("text")),
        _lines(listed, 2, F.col("n"), F.col("text")),
        _lines(middle, 3, F.lit(0), F.col("text")),
        _lines(timeline, 3, F.col("n"), F.col("text")),
    ]
    return reduce(DataFrame.unionByName, parts)

"""Threshold detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.operators.ranking import top_per_group
from casewise.operators.skew import broadcast_if_small
from casewise.taxonomy import BRUTE_FORCE_WINDOW_MINUTES, DETECTION_RULES

RULE_SCHEMA = "rule_name string, title string, event_type string, threshold long, severity string, confidence double"
EVENTS_SHOWN = 5


def detection_rules(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The rule catalogue; more rules of the same shape may be added."""
    return spark.createDataFrame([*DETECTION_RULES, *extra], RULE_SCHEMA)


def _matching_rows(events: DataFrame, rules: DataFrame) -> DataFrame:
    catalogue = rules.select("rule_name", "title", "event_type", "threshold", "severity", "confidence")
    return events.select("case_id", "event_type", "timestamp", "event_uid").join(
        broadcast_if_small(catalogue), "event_type"
    )


def detect(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One alert per case and rule whose event count reaches the threshold.

    Counting is partial before the shuffle, and the sample of first events is cut to five
    per group before it is gathered, so a rule that matches a third of all rows is harmless.
    """
    counts = events.groupBy("case_id", "event_type").agg(F.count(F.lit(1)).alias("event_count"))
    fired = counts.join(broadcast_if_small(rules), "event_type").where(F.col("event_count") >= F.col("threshold"))
    first = (
        first_events(events, rules)
        .groupBy("case_id", "rule_name")
        .agg(F.sort_array(F.collect_list(F.struct("position", "event_uid"))).alias("__shown"))
    )
    return fired.join(first, ["case_id", "rule_name"]).select(
        "case_id",
        "rule_name",
        "title",
        "severity",
        "confidence",
        "event_count",
        F.transform("__shown", lambda e: e["event_uid"]).alias("events"),
    )


def first_events(events: DataFrame, rules: DataFrame, shown: int = EVENTS_SHOWN) -> DataFrame:
    """The first matching events of each rule and case, by time."""
    order = [F.col("timestamp").asc_nulls_first(), F.col("event_uid").asc()]
    return top_per_group(_matching_rows(events, rules), ["case_id", "rule_name"], order, shown, "position").select(
        "case_id", "rule_name", "position", "event_uid", "timestamp"
    )


def windowed_counts(
    events: DataFrame,
    event_type: str = "Failed Logon",
    minutes: int = BRUTE_FORCE_WINDOW_MINUTES,
    by: tuple[str, ...] = ("case_id", "user"),
) -> DataFrame:
    """Event counts in tumbling windows; works on batch and streaming frames alike."""
    return (
        events.where(F.col("event_type") == event_type)
        .groupBy(F.window("timestamp", f"{minutes} minutes").alias("window"), *by)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(
            *by,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "event_count",
        )
    )


def windowed_brute_force(
    events: DataFrame,
    threshold: int = 5,
    minutes: int = BRUTE_FORCE_WINDOW_MINUTES,
    by: tuple[str, ...] = ("case_id", "user"),
) -> DataFrame:
    """Windows with at least ``threshold`` failed logons."""
    return windowed_counts(events, minutes=minutes, by=by).where(F.col("event_count") >= threshold)

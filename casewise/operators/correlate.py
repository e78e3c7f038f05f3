"""Correlation of events that share a user or an address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions.text import present
from casewise.operators.skew import attach_group


def correlate_events(events: DataFrame, scope: Sequence[str] = ("case_id",)) -> DataFrame:
    """Count the other events of the same user and of the same address.

    More than three of them make the event suspicious, with confidence
    min(.95, .5 + .05 n); otherwise both columns stay as they were.
    """
    rows = events.withColumn("__user", present(F.col("user"))).withColumn("__ip", present(F.col("ip_address")))
    counted = attach_group(rows, [*scope, "__user"], [F.count(F.lit(1)).alias("__same_user")])
    counted = attach_group(counted, [*scope, "__ip"], [F.count(F.lit(1)).alias("__same_ip")], among=rows)
    others = (
        F.coalesce(F.col("__same_user") - 1, F.lit(0)) + F.coalesce(F.col("__same_ip") - 1, F.lit(0))
    ).cast("long")
    flagged = counted.withColumn("correlation_count", others)
    many = F.col("correlation_count") > 3
    return (
        flagged.withColumn("is_suspicious", F.when(many, True).otherwise(F.col("is_suspicious")))
        .withColumn(
            "confidence_score",
            F.when(many, F.least(F.lit(0.95), F.lit(0.5) + F.col("correlation_count") * 0.05)).otherwise(
                F.col("confidence_score")
            ),
        )
        .select(*events.columns, "correlation_count")
    )

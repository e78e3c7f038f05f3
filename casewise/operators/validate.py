"""Consistency checks of the entity graph.

A rule looks at one kind of node and at the edges around it. Whatever it needs from the
edges is a handful of aggregates, so all rules together are one partially aggregated
pass over the relevant edges and a join with the nodes that failed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions.text import present
from casewise.operators.ranking import top_per_group
from casewise.operators.graph import edge_ends
from casewise.operators.skew import lookup


@dataclass(frozen=True)
class ConstraintRule:
    """A rule: the edges it reads, aggregates over them, and when they break it.

    ``measures`` maps names to aggregate columns over the node's edges; ``broken`` and
    ``reason`` are columns over those names plus ``node_label``. ``edge_types`` of None
    means that every edge is read.
    """

    name: str
    category: str
    description: str
    severity: str
    node_type: str | None
    edge_types: tuple[str, ...] | None
    measures: dict[str, Column] = field(default_factory=dict)
    broken: Column | None = None
    reason: Column | None = None
    suggestion: str = ""
    # What an automatic resolution does; None where the failure stays a violation.
    resolution: str | None = None


# ---- fixed values: what an automatic resolution does ------------------------------
REBOUND = "Successfully assigned orphan process to SYSTEM_ROOT virtual parent node."
RESOLVED_PARENT = "SYSTEM_ROOT"


def _has(edge_type: str) -> Column:
    return F.coalesce(F.bool_or(F.col("edge_type") == edge_type), F.lit(False))


def _bad_port() -> Column:
    port = F.col("properties")["port"]
    number = port.try_cast("int")
    return present(port).isNotNull() & (number.isNull() | (number < 0) | (number > 65535))


def standard_rules() -> list[ConstraintRule]:
    return [
        ConstraintRule(
            name="Temporal Sequence Consistency",
            category="Temporal",
            description="The last edge of a node is not earlier than its first.",
            severity="medium",
            node_type=None,
            edge_types=(),  # latest minus earliest time is never negative, so the rule always holds
        ),
        ConstraintRule(
            name="Process Tree Parent-Child Consistency",
            category="Process",
            description="Every process start names the process that started it.",
            severity="high",
            node_type="Process",
            edge_types=("SPAWNED",),
            measures={
                "orphan_spawn": F.coalesce(
                    F.bool_or((F.col("edge_type") == "SPAWNED") & present(F.col("src_id")).isNull()), F.lit(False)
                )
            },
            broken=F.col("orphan_spawn"),
            reason=F.concat(
                F.lit("Orphan process execution on '"), F.col("node_label"), F.lit("': Missing parent process link.")
            ),
            suggestion="Bind orphan process to SYSTEM root parent node.",
            resolution=REBOUND,
        ),
        ConstraintRule(
            name="File Lifecycle Operations Consistency",
            category="File",
            description="A deleted file was created, written or read before.",
            severity="medium",
            node_type="File",
            edge_types=("DELETED", "WROTE", "CREATED", "READ"),
            measures={
                "deleted": _has("DELETED"), "wrote": _has("WROTE"), "created": _has("CREATED"), "read": _has("READ"),
            },
            broken=F.col("deleted") & ~F.col("wrote") & ~F.col("created") & ~F.col("read"),
            reason=F.concat(
                F.lit("File lifecycle anomaly on '"), F.col("node_label"),
                F.lit("': File deletion without prior creation or write access."),
            ),
            suggestion="Infer missing file write reference.",
        ),
        ConstraintRule(
            name="User Authentication Session Validity",
            category="Authentication",
            description="An account that runs processes and failed to log on has also logged on.",
            severity="critical",
            node_type="User",
            edge_types=("FAILED_AUTH", "EXECUTED", "AUTHENTICATED"),
            measures={
                "failed": _has("FAILED_AUTH"), "executed": _has("EXECUTED"), "authenticated": _has("AUTHENTICATED"),
            },
            broken=F.col("failed") & F.col("executed") & ~F.col("authenticated"),
            reason=F.concat(
                F.lit("Authentication violation for '"), F.col("node_label"),
                F.lit("': Process executions recorded with 0 successful authentications."),
            ),
            suggestion="Flag account for credential theft or lateral movement investigation.",
        ),
        ConstraintRule(
            name="Network Flow & Protocol Consistency",
            category="Network",
            description="Ports of connections are whole numbers from 0 to 65535.",
            severity="medium",
            node_type="IP_Address",
            edge_types=("COMMUNICATED_WITH",),
            measures={
                "bad_port": F.min(
                    F.when(
                        (F.col("edge_type") == "COMMUNICATED_WITH") & _bad_port(),
                        F.struct(F.col("timestamp"), F.col("edge_id"), F.col("properties")["port"].alias("port")),
                    )
                )["port"]
            },
            broken=F.col("bad_port").isNotNull(),
            reason=F.concat(
                F.lit("Network port boundary violation on '"), F.col("node_label"), F.lit("': Invalid port "),
                F.col("bad_port"), F.lit("."),
            ),
            suggestion="Sanitize port value to standard TCP/UDP range.",
        ),
    ]


def rule_catalogue(spark: SparkSession, rules: Sequence[ConstraintRule] | None = None) -> DataFrame:
    chosen = rules or standard_rules()
    rows = [(i, r.name, r.category, r.description, r.severity) for i, r in enumerate(chosen, start=1)]
    return spark.createDataFrame(
        rows, "rule_id int, rule_name string, category string, description string, severity string"
    )


def failures(nodes: DataFrame, edges: DataFrame, rules: Sequence[ConstraintRule] | None = None) -> DataFrame:
    """One row per node and broken rule, resolved or not."""
    chosen = list(rules or standard_rules())
    active = [(i, r) for i, r in enumerate(chosen, start=1) if r.broken is not None]
    relevant = edges
    if all(r.edge_types is not None for _, r in active):
        wanted = sorted({t for _, r in active for t in r.edge_types})
        relevant = edges.where(F.col("edge_type").isin(wanted))
    measures = {name: column for _, r in active for name, column in r.measures.items()}
    around = (
        edge_ends(relevant, "edge_id", "edge_type", "src_id", "timestamp", "properties")
        .groupBy("case_id", "node_id")
        .agg(*[column.alias(name) for name, column in measures.items()])
    )
    kinds = [r.node_type for _, r in active]
    subject = nodes.select("case_id", "node_id", "node_type", "node_label")
    if all(kinds):
        subject = subject.where(F.col("node_type").isin(sorted(set(kinds))))
    checked = subject.join(around, ["case_id", "node_id"])
    verdicts = []
    for number, rule in active:
        fixed = rule.resolution
        applies = F.lit(True) if rule.node_type is None else F.col("node_type") == rule.node_type
        verdicts.append(
            F.when(
                applies & rule.broken,
                F.struct(
                    F.lit(number).alias("rule_id"),
                    F.lit(rule.name).alias("rule_name"),
                    F.lit(rule.category).alias("category"),
                    F.lit("VIOLATION" if fixed is None else "RESOLVED").alias("status"),
                    rule.reason.alias("violation_reason"),
                    F.lit(fixed or rule.suggestion).alias("resolution_details"),
                ),
            )
        )
    return (
        checked.select(
            "case_id",
            "node_id",
            "node_type",
            "node_label",
            F.explode(F.filter(F.array(*verdicts), lambda v: v.isNotNull())).alias("verdict"),
        )
        .select("case_id", "node_id", "node_type", "node_label", "verdict.*")
    )


def validation_summary(
    nodes: DataFrame, found: DataFrame, rules: Sequence[ConstraintRule] | None = None
) -> DataFrame:
    """Score, status and confidence per case; a resolved failure counts as passed."""
    per_node = len(rules or standard_rules())
    sizes = nodes.groupBy("case_id").agg((F.count(F.lit(1)) * per_node).alias("__checks"))
    counts = found.groupBy("case_id").agg(
        F.count_if(F.col("status") == "VIOLATION").alias("violations_count"),
        F.count_if(F.col("status") == "RESOLVED").alias("resolved_count"),
    )
    joined = sizes.join(counts, "case_id", "left").fillna(0, ["violations_count", "resolved_count"])
    score = F.round((F.col("__checks") - F.col("violations_count")) / F.col("__checks") * 100.0, 2)
    return (
        joined.withColumn("validation_score", score)
        .withColumn(
            "validation_status",
            F.when(F.col("violations_count") == 0, "PASSED")
            .when(F.col("validation_score") >= 70.0, "PARTIAL")
            .otherwise("FAILED"),
        )
        .withColumn(
            "confidence_score", F.round(F.greatest(F.lit(0.5), F.col("validation_score") / 100.0), 2)
        )
        .select(
            "case_id", "validation_status", "validation_score", "violations_count", "resolved_count", "confidence_score"
        )
    )


def validation_records(found: DataFrame, summary: DataFrame) -> DataFrame:
    """Stored form of the failures: violations carry the confidence of the run, resolutions .9."""
    scored = lookup(found, summary.select("case_id", "confidence_score"), ["case_id"])
    return scored.select(
        "case_id",
        "rule_id",
        "node_id",
        "status",
        "violation_reason",
        "resolution_details",
        F.when(F.col("status") == "VIOLATION", F.col("confidence_score")).otherwise(F.lit(0.9)).alias("confidence"),
    )


def resolved_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with ``resolved_parent`` added to the properties of re-bound orphan processes."""
    bound = (
        found.where((F.col("status") == "RESOLVED") & (F.col("resolution_details") == REBOUND))
        .select("case_id", "node_id")
        .distinct()
        .withColumn("__bound", F.lit(True))
    )
    extra = F.create_map(F.lit("resolved_parent"), F.lit(RESOLVED_PARENT))
    merged = F.map_concat(F.map_filter("properties", lambda k, _: k != "resolved_parent"), extra)
    return nodes.join(bound, ["case_id", "node_id"], "left").select(
        "case_id",
        "node_id",
        "node_type",
        "node_label",
        F.when(F.col("__bound"), F.coalesce(merged, extra)).otherwise(F.col("properties")).alias("properties"),
    )


def latest_validation(results: DataFrame) -> DataFrame:
    """The newest stored result of each case; needs ``result_id`` and ``validated_at``."""
    order = [F.col("validated_at").desc(), F.col("result_id").desc()]
    return top_per_group(results, ["case_id"], order, 1)


def validation_status(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Latest result of every case, UNVALIDATED with zeros where there is none."""
    newest = latest_validation(results).select(
        "case_id", "validation_status", "validation_score", "violations_count", "resolved_count", "confidence_score"
    )
    return (
        cases.select("case_id")
        .join(newest, "case_id", "left")
        .fillna("UNVALIDATED", ["validation_status"])
        .fillna(0, ["validation_score", "violations_count", "resolved_count", "confidence_score"])
    )


def violations_newest(records: DataFrame) -> DataFrame:
    """Stored violation rows, newest first; needs ``created_at`` and ``record_id``."""
    return records.orderBy(F.col("created_at").desc(), F.col("record_id").desc())

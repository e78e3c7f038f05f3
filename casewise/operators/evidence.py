"""Evidence files: gate, duplicates, stages and custody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.scoring import activity_severity, activity_text, activity_time
from casewise.functions.text import contains_any, first_present, present
from casewise.operators.ranking import page
from casewise.operators.skew import attach_group, lookup


def content_hashes(content: Column) -> list[Column]:
    return [
        F.sha2(content, 256).alias("sha256"),
        F.sha1(content).alias("sha1"),
        F.md5(content).alias("md5"),
    ]


def clean_name(name: Column) -> Column:
    """Base name with unusual characters replaced and outer underscores removed."""
    base = F.element_at(F.split(name, "/"), -1)
    safe = F.regexp_replace(base, r"(?U)[^\w.\-]", "_")
    return first_present([F.regexp_replace(safe, "^_+|_+$", "")], "evidence.log")


def extension(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -1))).otherwise("")


def file_gate(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Accept or reject files by extension; needs ``filename`` and ``size``.

    Files of any size are accepted unless the caller names a limit.
    """
    named = files.withColumn("clean_name", clean_name(F.coalesce(F.col("filename"), F.lit("")))).withColumn(
        "extension", extension(F.col("clean_name"))
    )
    reason = (
        F.when(F.col("extension").isin(X.BLOCKED_EXTENSIONS), "blocked_extension")
        .when(~F.col("extension").isin(X.ALLOWED_EXTENSIONS), "unsupported_extension")
        .when(F.coalesce(F.col("size"), F.lit(0)) == 0, "empty_file")
    )
    if max_bytes is not None:
        reason = reason.when(F.col("size") > max_bytes, "too_large")
    return named.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def route_format(files: DataFrame) -> DataFrame:
    """Reader and evidence type of each file from ``clean_name`` and ``extension``."""
    ext, base = F.col("extension"), F.lower(F.col("clean_name"))
    reader = (
        F.when(ext == "evtx", "winevent")
        .when(ext.isin("csv", "json", "xml", "zip"), ext)
        .when(ext.isin(X.LINE_LOG_EXTENSIONS) & contains_any(base, X.SYSLOG_NAME_HINTS), "syslog")
        .otherwise("text")
    )
    kind = F.when(ext.isin(X.ALLOWED_EXTENSIONS), ext).otherwise("log")
    return files.withColumn("format", reader).withColumn("evidence_type", kind)


def mark_duplicates(
    files: DataFrame, stored: DataFrame | None = None, order: str = "evidence_id"
) -> DataFrame:
    """Flag files whose hash is already stored in the case or came earlier in the batch.

    The first file of each hash is found with a partially aggregated minimum, so a hash
    that makes up a third of the batch does not gather in one task.
    """
    marked = attach_group(files, ["case_id", "sha256"], [F.min(order).alias("first_copy")])
    if stored is not None:
        known = stored.select("case_id", "sha256").distinct().withColumn("__stored", F.lit(True))
        first = marked.where(F.col(order) == F.col("first_copy")).select("case_id", "sha256").join(
            known, ["case_id", "sha256"], "left_semi"
        )
        marked = attach_known(marked, first)
    else:
        marked = marked.withColumn("__known", F.lit(False))
    return marked.withColumn(
        "is_duplicate", F.col("__known") | (F.col(order) != F.col("first_copy"))
    ).drop("__known")


def attach_known(files: DataFrame, known: DataFrame) -> DataFrame:
    table = known.withColumn("__known", F.lit(True))
    return lookup(files, table, ["case_id", "sha256"]).withColumn(
        "__known", F.coalesce(F.col("__known"), F.lit(False))
    )


def dedupe_evidence(files: DataFrame, stored: DataFrame | None = None, order: str = "evidence_id") -> DataFrame:
    """Keep the first file of each hash in a case, unless the case already holds that hash."""
    columns = [c for c in files.columns if c not in ("case_id", "sha256")]
    first = (
        files.groupBy("case_id", "sha256")
        .agg(F.min_by(F.struct(*columns), order).alias("__first"))
        .select("case_id", "sha256", "__first.*")
        .select(*files.columns)
    )
    if stored is None:
        return first
    return first.join(stored.select("case_id", "sha256"), ["case_id", "sha256"], "left_anti")


def stage_update(
    evidence: DataFrame,
    events: DataFrame,
    normalized: DataFrame,
    nodes: DataFrame,
    validations: DataFrame,
) -> DataFrame:
    """Stage of each evidence file, derived from which output tables hold rows for it.

    A later stage counts only when all earlier ones are done.
    """
    parsed = events.select("evidence_id").distinct().withColumn("__parsed", F.lit(True))
    normal = normalized.select("evidence_id").distinct().withColumn("__normalized", F.lit(True))
    graphed = nodes.select("case_id").distinct().withColumn("__graphed", F.lit(True))
    checked = validations.select("case_id").distinct().withColumn("__checked", F.lit(True))
    joined = evidence.join(parsed, "evidence_id", "left").join(normal, "evidence_id", "left")
    joined = lookup(joined, graphed, ["case_id"])
    joined = lookup(joined, checked, ["case_id"])
    done = [("VERIFIED", present(F.col("sha256")).isNotNull())]
    for stage, flag in [
        ("PARSED", "__parsed"),
        ("NORMALIZED", "__normalized"),
        ("GRAPH_CREATED", "__graphed"),
        ("CSP_VALIDATED", "__checked"),
    ]:
        done.append((stage, done[-1][1] & F.coalesce(F.col(flag), F.lit(False))))
    stage = F.lit("UPLOADED")
    for name, reached in done:
        stage = F.when(reached, name).otherwise(stage)
    return joined.withColumn("processing_stage", stage).drop("__parsed", "__normalized", "__graphed", "__checked")


def custody_entries(rows: DataFrame, action: str, at: Column, user_id: int | None = None) -> DataFrame:
    """One audit row per evidence file that a job touched, with the number of rows it wrote."""
    return (
        rows.groupBy("evidence_id")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(
            "evidence_id",
            F.lit(user_id).cast("long").alias("user_id"),
            F.lit(action).alias("action"),
            at.cast("timestamp").alias("timestamp"),
            F.create_map(F.lit("rows"), F.col("__rows").cast("string")).alias("details"),
        )
    )


def custody_trail(log: DataFrame, evidence_id: int) -> DataFrame:
    return log.where(F.col("evidence_id") == evidence_id).orderBy("timestamp", "log_id")


def recent_activity(log: DataFrame, count: int = 6) -> DataFrame:
    """The newest audit rows as an activity feed; ``details`` is empty where the log has none."""
    nothing = F.create_map().cast("map<string,string>")
    details = F.coalesce("details", nothing) if "details" in log.columns else nothing
    newest = page(log, [F.col("timestamp").desc(), F.col("log_id").desc()], 0, count)
    return newest.select(
        "log_id",
        activity_text(F.col("action"), F.col("evidence_id")).alias("action"),
        activity_time(F.col("timestamp")).alias("time"),
        details.alias("details"),
        activity_severity(F.col("action")).alias("severity"),
    )

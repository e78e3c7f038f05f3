"""Case data derived from the general test tables.

The test tables are not security logs. The functions here turn them, with plain column
expressions, into frames of the library's schemas so that every operator can be run on
them. The same expressions are written once more in SQL in ``oracle.py``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions.events import event_key, parsed_confidence
from casewise.functions.normalize import normalize
from casewise.functions.winevent import event_name
from casewise.schemas import EVENT_COLUMNS
from casewise.session import configure
from casewise.taxonomy import ALERT_SEVERITIES

CASES = 8
FILES_PER_CASE = 16

DESCRIPTIONS = [
    "concat('Failed password for account_', user_id, ' from 172.16.', k % 7, '.', k, ' port 22')",
    "concat('Accepted password for account_', user_id, ' from 172.17.', k % 5, '.', k)",
    "concat('sudo: account_', user_id, ' opened a shell')",
    "'USB mass storage attached'",
    "concat('Process started by scheduler on 192.168.1.', k)",
    "'write to network share'",
    "'Reg key changed'",
    "concat('network scan of 10.9.8.', k)",
    "concat('download of archive from 203.0.113.', k)",
    "'heartbeat'",
    "'EXECVE audit record'",
    "'Logged in via console'",
]


def planned_once(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Keep the (lazy) frame of a session and folder, since building the plan takes longer than reusing it."""
    frames: dict[tuple[str, str], DataFrame] = {}

    @functools.wraps(build)
    def planned(spark: SparkSession, folder: str) -> DataFrame:
        key = (f"{spark.sparkContext.applicationId}/{id(spark._jsparkSession)}", folder)
        if key not in frames:
            frames[key] = build(spark, folder)
        return frames[key]

    return planned


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _cases_of(expression: str, choices: list[str]) -> str:
    branches = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(choices))
    return f"CASE {expression} {branches} END"


@planned_once
def case_events(spark: SparkSession, folder: str) -> DataFrame:
    """Universal events derived from the ``events`` table."""
    base = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        "user_id",
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    shaped = base.select(
        "seq",
        "k",
        "value",
        "user_id",
        "kind",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr(f"user_id % {CASES}").alias("case_id"),
        F.expr(f"user_id % {CASES} * {FILES_PER_CASE} + seq % {FILES_PER_CASE}").alias("evidence_id"),
        F.expr(
            "CASE WHEN k % 4 = 3 THEN NULL WHEN kind = 'error' THEN '4625' WHEN kind = 'signup' THEN '4720' "
            "WHEN kind = 'purchase' THEN '4688' WHEN kind = 'view' THEN '4663' ELSE '4624' END"
        ).alias("event_id"),
        F.expr(
            "CASE WHEN k = 50 THEN NULL WHEN k % 7 = 0 THEN concat('user_', user_id, '@corp.example') "
            "WHEN k % 7 = 1 THEN concat('user_', user_id) ELSE concat('CORP\\\\user_', user_id) END"
        ).alias("user"),
        F.expr("concat('host-', user_id % 10)").alias("host"),
        F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE concat('10.0.', k % 4, '.', k) END").alias("ip_address"),
        F.expr(
            "CASE WHEN kind <> 'purchase' THEN NULL WHEN value > 100 THEN 'cmd.exe' "
            "WHEN k % 10 = 0 THEN 'wmiprvse.exe' WHEN k % 10 < 4 THEN 'powershell.exe' "
            "ELSE concat('svc_', k, '.exe') END"
        ).alias("process"),
        F.expr("CASE WHEN kind = 'view' OR k % 25 = 24 THEN concat('/srv/share/file_', seq % 500) END").alias("file_path"),
        F.expr(
            "CASE WHEN kind = 'error' THEN CASE WHEN value > 20 THEN 'critical' ELSE 'high' END "
            "WHEN kind = 'signup' THEN 'high' WHEN kind = 'purchase' THEN 'medium' "
            "WHEN kind = 'click' AND value > 40 THEN 'high' ELSE 'low' END"
        ).alias("severity"),
        F.expr(_cases_of("k % 12", DESCRIPTIONS)).alias("description"),
        F.expr(
            "to_variant_object(named_struct("
            "'CommandLine', CASE WHEN kind = 'purchase' THEN CASE WHEN value > 60 "
            "THEN 'vssadmin delete shadows /all' WHEN k % 9 = 0 THEN 'wmic process list' "
            "ELSE concat('run ', k) END END, "
            "'ParentProcessName', CASE WHEN kind = 'purchase' AND k % 2 = 0 THEN "
            "CASE WHEN k % 5 = 0 THEN 'cmd.exe' ELSE 'explorer.exe' END END, "
            "'pid', CASE WHEN k > 0 THEN k END, "
            "'ObjectName', CASE WHEN kind = 'view' THEN concat('object_', k) END, "
            "'TargetObject', CASE WHEN kind = 'signup' AND k % 5 = 0 THEN concat('HKLM/Software/Run/item_', k) END, "
            "'Protocol', CASE WHEN k % 6 = 0 THEN 'UDP' END, "
            "'DestinationIp', CASE WHEN kind IN ('click', 'error') AND k % 2 = 0 THEN "
            "concat('10.0.', (k * 3 + user_id) % 100 % 4, '.', (k * 3 + user_id) % 100) END, "
            "'DestinationPort', CASE WHEN k % 10 = 6 THEN 'http' ELSE cast(k * 1000 AS string) END))"
        ).alias("raw"),
    )
    named = shaped.withColumn(
        "event_type",
        F.when(F.col("event_id").isNotNull(), event_name(F.col("event_id"))).otherwise(
            F.expr(
                "CASE WHEN kind = 'error' THEN 'AuthFailure' WHEN kind = 'signup' THEN 'PrivilegeEscalation' ELSE 'CSVRecord' END"
            )
        ),
    )
    return named.select(
        event_key(F.col("evidence_id"), F.col("seq")).alias("event_uid"),
        "evidence_id",
        "case_id",
        "seq",
        "timestamp",
        F.lit(False).alias("ts_inferred"),
        F.lit("EventTable").alias("source"),
        "event_type",
        "event_id",
        "user",
        "host",
        "ip_address",
        "process",
        "file_path",
        "severity",
        "description",
        F.col("raw").alias("raw_data"),
        F.col("severity").isin(ALERT_SEVERITIES).alias("is_suspicious"),
        parsed_confidence(F.col("severity")).alias("confidence_score"),
    ).select(*EVENT_COLUMNS)


@planned_once
def normalized_events(spark: SparkSession, folder: str) -> DataFrame:
    return normalize(case_events(spark, folder))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases derived from the ``customer`` table."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("case_id"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("description"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' ELSE 'closed' END").alias("status"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END").alias("priority"),
        F.col("c_nationkey").cast("long").alias("investigator_id"),
        (F.col("c_acctbal") < 0).alias("is_deleted"),
    )


def evidence_files(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence files derived from the ``documents`` table: the text is the file, the source its case."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("evidence_id"),
        F.expr("cast(substring(source, 4) AS bigint)").alias("case_id"),
        F.expr(
            "concat('doc ', doc_id, CASE doc_id % 6 WHEN 0 THEN '.log' WHEN 1 THEN '.csv' WHEN 2 THEN '.json' "
            "WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE '_auth.log' END)"
        ).alias("filename"),
        F.expr("concat('upload/doc ', doc_id)").alias("original_filename"),
        F.expr("CASE doc_id % 6 WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'log' END").alias("file_type"),
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        F.sha1("text").alias("sha1"),
        F.md5("text").alias("md5"),
        (F.col("doc_id") % 5 != 0).alias("is_parsed"),
        (F.col("doc_id") % 17 == 0).alias("is_deleted"),
    )


def event_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """One evidence row per evidence id that occurs in the derived events."""
    found = case_events(spark, folder).groupBy("evidence_id").agg(
        F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("size")
    )
    return found.select(
        "evidence_id",
        "case_id",
        F.concat(F.lit("evidence_"), F.col("evidence_id").cast("string"), F.lit(".log")).alias("filename"),
        F.concat(F.lit("upload/evidence "), F.col("evidence_id").cast("string")).alias("original_filename"),
        F.lit("log").alias("file_type"),
        "size",
        F.lit(True).alias("is_parsed"),
        (F.col("evidence_id") % 9 == 0).alias("is_deleted"),
    )


def custody_log(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows derived from the ``orders`` table."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("log_id"),
        F.col("o_custkey").alias("evidence_id"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'UPLOAD' WHEN 'F' THEN 'PARSE' ELSE 'DELETE' END").alias("action"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.when(F.col("o_orderstatus") != "F", F.create_map(F.lit("priority"), F.col("o_orderpriority"))).alias("details"),
    )


def validation_results(spark: SparkSession, folder: str) -> DataFrame:
    """Stored validation results derived from the ``orders`` table."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("result_id"),
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderdate").cast("timestamp").alias("validated_at"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'PASSED' WHEN 'F' THEN 'PARTIAL' ELSE 'FAILED' END").alias("validation_status"),
        F.expr("cast(o_orderkey % 101 AS double)").alias("validation_score"),
        F.expr("o_orderkey % 7").alias("violations_count"),
        F.expr("o_orderkey % 3").alias("resolved_count"),
        F.expr("greatest(0.5D, (o_orderkey % 101) / 100.0D)").alias("confidence_score"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports derived from the ``orders`` table."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("report_id"),
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def syslog_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Syslog lines formatted from the ``events`` table; one line in eleven has another form."""
    text = _cases_of("k % 12", DESCRIPTIONS)
    return table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        F.expr(f"user_id % {CASES}").alias("case_id"),
        F.expr(f"user_id % {CASES} * {FILES_PER_CASE} + event_id % {FILES_PER_CASE}").alias("evidence_id"),
        F.col("event_id").alias("seq"),
        F.expr(
            "CASE WHEN k % 11 = 10 THEN concat('-- ', event_type, ' ', k) ELSE "
            "concat(date_format(ts, 'MMM d HH:mm:ss'), ' host-', user_id % 10, ' ', "
            "CASE event_type WHEN 'click' THEN 'sshd' WHEN 'view' THEN 'sudo' WHEN 'error' THEN 'sshd' "
            "WHEN 'signup' THEN 'useradd' ELSE 'CRON' END, "
            "CASE WHEN k % 2 = 0 THEN concat('[', k + 100, ']') ELSE '' END, ': ', "
            f"{text}) END"
        ).alias("line"),
    )

"""Normalization of universal events: one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.text import first_present, found, present
from casewise.schemas import NORMALIZED_EVENT


def rule_outcomes() -> list[tuple[str, str, str]]:
    """(category, action, severity) of every rule in order; the last one is the fallback."""
    return [rule[-3:] for rule in (*X.WIN_RULES, *X.KEYWORD_RULES)] + [X.RULE_OTHERWISE]


def _holds(column: str, words: list[str]) -> list[str]:
    return [f"contains({column}, '{word}')" for word in words]


def rule_number(event_type: str, event_id: str, description: str) -> Column:
    """Position of the rule that applies: exact Windows ids first, then keywords in order.

    The arguments are column names; type and description must be lower case and not null.
    The cascade yields a number instead of the texts, which keeps the generated code small;
    ``rule_text`` looks them up.
    """
    known_id = f"trim(coalesce({event_id}, ''))"
    tests = [f"{known_id} IN ({', '.join(repr(i) for i in ids)})" for ids, *_ in X.WIN_RULES]
    tests += [
        " OR ".join(_holds(event_type, type_words) + _holds(description, text_words))
        for type_words, text_words, *_ in X.KEYWORD_RULES
    ]
    branches = " ".join(f"WHEN {test} THEN {number}" for number, test in enumerate(tests))
    return F.expr(f"CASE {branches} ELSE {len(tests)} END")


def rule_text(number: Column, part: int) -> Column:
    """Category (0), action (1) or severity (2) of a rule number."""
    return F.get(F.array(*[F.lit(outcome[part]) for outcome in rule_outcomes()]), number)


def first_address(text: Column) -> Column:
    """First dotted quad in the text; the parts are not range-checked."""
    return found(text, X.DOTTED_QUAD, 0)


def domain_and_user(user: Column) -> Column:
    """Struct (domain, username) from ``domain\\user`` or ``user@domain``, split at the first mark."""
    slash, at = F.instr(user, "\\"), F.instr(user, "@")

    def head(position: Column) -> Column:
        return F.substring(user, F.lit(1), position - 1)

    def tail(position: Column) -> Column:
        return F.substring(user, position + 1, F.length(user))

    return F.struct(
        F.when(slash > 0, head(slash)).when(at > 0, tail(at)).alias("domain"),
        F.when(slash > 0, tail(slash)).when(at > 0, head(at)).alias("username"),
    )


def raw_fields(raw: Column) -> Column:
    """Struct of all aliases of the wanted raw record fields as text, read in one pass over the record."""
    aliases = [alias for names in X.RAW_FIELDS.values() for alias in names]
    return F.try_variant_get(raw, "$", f"struct<{', '.join(f'{a}: string' for a in aliases)}>")


def raw_field(extracted: Column, name: str) -> Column:
    """First non-empty of the aliases of a raw record field."""
    return first_present([extracted[alias] for alias in X.RAW_FIELDS[name]])


def port_number(text: Column) -> Column:
    """The port as an int when the text is all digits, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def normalize(events: DataFrame) -> DataFrame:
    """Universal events to normalized events; all rows, all cases."""
    staged = events.select(
        "*",
        F.lower(F.coalesce(F.col("event_type"), F.lit(""))).alias("__type"),
        F.lower(F.coalesce(F.col("description"), F.lit(""))).alias("__text"),
        domain_and_user(F.coalesce(F.col("user"), F.lit(""))).alias("__account"),
        raw_fields(F.col("raw_data")).alias("__raw"),
        first_address(F.col("description")).alias("__address"),
    )
    ruled = staged.withColumn("__rule", rule_number("__type", "event_id", "__text"))
    raw = F.col("__raw")
    return ruled.select(
        "event_uid",
        "case_id",
        "evidence_id",
        "seq",
        F.col("timestamp").alias("timestamp_utc"),
        first_present([F.col("host")], "UNKNOWN_HOST").alias("hostname"),
        F.col("host").alias("device_name"),
        first_present([F.col("__account.username"), F.col("user")], "UNKNOWN_USER").alias("username"),
        F.col("__account.domain").alias("domain"),
        F.coalesce(present(F.col("ip_address")), F.col("__address"), F.col("ip_address")).alias("ip_address"),
        F.col("process").alias("process_name"),
        F.coalesce(raw_field(raw, "process_id"), F.lit("")).alias("process_id"),
        raw_field(raw, "parent_process").alias("parent_process"),
        raw_field(raw, "command_line").alias("command_line"),
        first_present([F.col("event_type")], "ParsedEvent").alias("event_type"),
        rule_text(F.col("__rule"), 0).alias("event_category"),
        rule_text(F.col("__rule"), 2).alias("severity"),
        rule_text(F.col("__rule"), 1).alias("action"),
        raw_field(raw, "object_name").alias("object_name"),
        "file_path",
        raw_field(raw, "registry_key").alias("registry_key"),
        F.coalesce(raw_field(raw, "network_protocol"), F.lit("TCP")).alias("network_protocol"),
        raw_field(raw, "destination_ip").alias("destination_ip"),
        port_number(raw_field(raw, "destination_port")).alias("destination_port"),
        first_present([F.col("source")], "ParserEngine").alias("source"),
        F.col("source").alias("parser_source"),
        F.coalesce(
            F.nullif(F.col("confidence_score"), F.lit(0.0)), F.lit(X.NORMALIZED_CONFIDENCE_DEFAULT)
        ).alias("confidence_score"),
        F.col("raw_data").alias("raw_event_reference"),
        F.lit(True).alias("normalized"),
    ).select(*NORMALIZED_EVENT.fieldNames())

"""Facts from events and forward-chaining threat rules.

A rule fires for a case when each of its premises is met by some fact of the case. Whether
a premise is met is one partially aggregated boolean per case, so all facts are read once;
the rounds of the chain then work on one short row per case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions.text import contains_any, first_present
from casewise.operators.ranking import number_rows
from casewise.operators.skew import lookup
from casewise.schemas import FACT
from casewise.session import materialize

BURST_SIZE = 3


def _none_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _fact(when: Column, kind: str, entity: Column, value: Column, confidence: float) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("fact_type"), entity.alias("entity"), value.alias("value"),
            F.lit(confidence).alias("confidence"),
        ),
    )


def event_facts(normalized: DataFrame) -> DataFrame:
    """Up to four facts per event, with the position that orders them within a case."""

    def upper(name: str) -> Column:
        return F.upper(F.coalesce(F.col(name), F.lit("")))

    action, command, process = upper("action"), upper("command_line"), upper("process_name")
    user = F.concat(F.lit("user:"), first_present([F.col("username")], "unknown"))
    host = F.concat(F.lit("host:"), first_present([F.col("hostname")], "unknown"))
    items = F.array(
        _fact(contains_any(action, ["FAIL", "DENIED"]), "AUTH_FAILURE", user, F.col("action"), 0.9),
        _fact(
            contains_any(command, ["VSSADMIN", "DELETE SHADOWS"]), "SHADOW_COPY_DELETION", host,
            F.col("command_line"), 0.95,
        ),
        _fact(
            contains_any(process, ["POWERSHELL", "CMD.EXE"]), "SUSPICIOUS_PROCESS_EXECUTION", host,
            F.col("process_name"), 0.85,
        ),
        _fact(
            process.contains("WMI") | command.contains("WMI"), "WMI_EXECUTION", host,
            first_present([F.col("command_line"), F.col("process_name")]), 0.9,
        ),
    )
    return normalized.select(
        "case_id",
        "timestamp_utc",
        "event_uid",
        F.posexplode(F.filter(items, lambda f: f.isNotNull())).alias("slot", "fact"),
    ).select("case_id", "timestamp_utc", "event_uid", "slot", "fact.*")


def auth_failure_burst(facts: DataFrame, least: int = BURST_SIZE) -> DataFrame:
    """One fact per case with at least ``least`` authentication failures."""
    return (
        facts.groupBy("case_id")
        .agg(F.count_if(F.col("fact_type") == "AUTH_FAILURE").alias("__n"), F.count(F.lit(1)).alias("__all"))
        .where(F.col("__n") >= least)
        .select(
            "case_id",
            F.lit("AUTH_FAILURE_BURST").alias("fact_type"),
            F.lit("AUTHENTICATION_SERVICE").alias("entity"),
            F.concat(F.col("__n").cast("string"), F.lit("_failures")).alias("value"),
            F.lit(0.9).alias("confidence"),
            (F.col("__all") + 1).alias("__number"),
        )
    )


def facts_from_events(normalized: DataFrame, numbered: bool = False, custom: DataFrame | None = None) -> DataFrame:
    """Facts of every case: from events, the failure burst, then facts given by the caller.

    ``numbered`` gives the ids DB_F_1, DB_F_2, ... in time order; that needs a distributed
    sort, so the plain form derives the id from the event instead.
    """
    single = event_facts(normalized)
    burst = auth_failure_burst(single)
    if numbered:
        order = [F.col("timestamp_utc").asc(), F.col("event_uid").asc(), F.col("slot").asc()]
        single = number_rows(single, ["case_id"], order, "__number")
        name = F.concat(F.lit("DB_F_"), F.col("__number").cast("string"))
        burst_name = name
    else:
        name = F.sha2(F.concat_ws("|", "event_uid", F.col("slot").cast("string")), 256)
        burst_name = F.lit("DB_F_BURST")
    columns = [f.name for f in FACT.fields]
    facts = (
        single.withColumn("fact_id", name)
        .unionByName(burst.withColumn("fact_id", burst_name), allowMissingColumns=True)
        .withColumn("properties", _none_map())
        .select(*columns)
    )
    return facts.unionByName(custom.select(*columns)) if custom is not None else facts


def custom_facts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Facts handed in by the caller; missing parts get the usual defaults."""
    shaped = [
        (
            r["case_id"], r.get("fact_id") or f"CUSTOM_F_{i}", r["fact_type"], r["entity"],
            str(r.get("value", True)), float(r.get("confidence", 1.0)), dict(r.get("properties") or {}),
        )
        for i, r in enumerate(rows, start=1)
    ]
    return spark.createDataFrame(shaped, FACT)


def counted_facts(facts: DataFrame) -> DataFrame:
    """One fact per (case, type, entity, value): the one with the smallest id, and the number of copies."""
    rest = F.min(F.struct("fact_id", "confidence")).alias("__kept")
    return (
        facts.groupBy("case_id", "fact_type", "entity", "value")
        .agg(rest, F.count(F.lit(1)).alias("copies"))
        .select("case_id", "__kept.fact_id", "fact_type", "entity", "value", "__kept.confidence", "copies")
    )


def distinct_facts(facts: DataFrame) -> DataFrame:
    return counted_facts(facts).drop("copies")


@dataclass(frozen=True)
class Conclusion:
    fact_id: str
    fact_type: str
    entity: str
    value: str
    confidence: float


@dataclass(frozen=True)
class InferenceRule:
    """IF each premise is met by some fact THEN add the conclusions.

    A premise is a boolean column over fact_type, entity and value. ``context`` marks further
    facts that are logged as triggers without being required.
    """

    rule_id: str
    name: str
    category: str
    severity: str
    premises: tuple[Column, ...]
    conclusions: tuple[Conclusion, ...]
    context: Column | None = None

    def trigger(self) -> Column:
        hit = F.lit(False)
        for premise in (*self.premises, *([self.context] if self.context is not None else [])):
            hit = hit | F.coalesce(premise, F.lit(False))
        return hit


def standard_rules() -> list[InferenceRule]:
    kind, value = F.col("fact_type"), F.lower(F.coalesce(F.col("value"), F.lit("")))
    return [
        InferenceRule(
            "RULE_01_BRUTE_FORCE", "Brute Force Authentication Pattern", "AUTHENTICATION", "HIGH",
            (kind == "AUTH_FAILURE_BURST",),
            (
                Conclusion("F_BF_01", "SUSPECTED_BRUTE_FORCE", "AUTHENTICATION_SERVICE", "True", 0.85),
                Conclusion("F_BF_02", "THREAT_INDICATOR", "ACCOUNT_COMPROMISE_RISK", "HIGH", 0.85),
            ),
        ),
        InferenceRule(
            "RULE_02_WMI_LATERAL", "WMI Remote Script Execution", "LATERAL_MOVEMENT", "CRITICAL",
            (
                kind.isin("SUSPICIOUS_PROCESS_EXECUTION", "PROCESS_CREATE")
                & contains_any(value, ["powershell", "cmd.exe"]),
                kind == "WMI_EXECUTION",
            ),
            (
                Conclusion("F_LAT_01", "THREAT_TACTIC", "LATERAL_MOVEMENT_WMI", "T1047", 0.90),
                Conclusion("F_LAT_02", "ALERT_GENERATED", "REMOTE_COMMAND_EXECUTION", "CRITICAL", 0.90),
            ),
        ),
        InferenceRule(
            "RULE_03_RANSOMWARE", "Volume Shadow Copy Tampering & Encryption", "DEFENSE_EVASION", "CRITICAL",
            ((kind == "SHADOW_COPY_DELETION") | value.contains("vssadmin"),),
            (
                Conclusion("F_RANSOM_01", "CRITICAL_THREAT", "RANSOMWARE_ACTIVITY", "T1490", 0.95),
                Conclusion("F_RANSOM_02", "INCIDENT_HYPOTHESIS", "SYSTEM_DESTRUCTIVE_ATTACK", "CRITICAL", 0.95),
            ),
            context=kind.isin("MASS_FILE_RENAME", "HIGH_ENTROPY_FILE_WRITE"),
        ),
    ]


def _same_fact(conclusion: Conclusion) -> Column:
    return (
        (F.col("fact_type") == conclusion.fact_type)
        & (F.col("entity") == conclusion.entity)
        & (F.col("value") == conclusion.value)
    )


def _conclusion_meets(spark: SparkSession, rules: Sequence[InferenceRule]) -> dict[tuple[int, int], set[int]]:
    """For each premise (rule, position): the rules whose conclusions meet it."""
    rows = [
        (i, c.fact_type, c.entity, c.value) for i, rule in enumerate(rules) for c in rule.conclusions
    ]
    if not rows:
        return {}
    table = spark.createDataFrame(rows, "rule int, fact_type string, entity string, value string")
    tests = [
        F.coalesce(p, F.lit(False)).alias(f"p_{i}_{j}") for i, r in enumerate(rules) for j, p in enumerate(r.premises)
    ]
    meets: dict[tuple[int, int], set[int]] = {}
    for row in table.select("rule", *tests).collect():  # as many rows as there are conclusions
        for i, r in enumerate(rules):
            for j in range(len(r.premises)):
                if row[f"p_{i}_{j}"]:
                    meets.setdefault((i, j), set()).add(row["rule"])
    return meets


def chain(counted: DataFrame, rules: Sequence[InferenceRule] | None = None) -> DataFrame:
    """One row per case: which rules fired and in which round, and the fact counts.

    ``counted`` comes from ``counted_facts``.

    ``fired`` holds the round per rule (null when it did not fire) and ``added`` tells, per
    rule and conclusion, whether the conclusion was new.
    """
    rules = list(rules or standard_rules())
    meets = _conclusion_meets(counted.sparkSession, rules)
    flags = [
        F.coalesce(F.bool_or(F.coalesce(p, F.lit(False))), F.lit(False)).alias(f"met_{i}_{j}")
        for i, r in enumerate(rules)
        for j, p in enumerate(r.premises)
    ]
    known = {}
    for i, rule in enumerate(rules):
        for j, conclusion in enumerate(rule.conclusions):
            key = (conclusion.fact_type, conclusion.entity, conclusion.value)
            known.setdefault(key, (f"known_{i}_{j}", _same_fact(conclusion)))
    state = counted.groupBy("case_id").agg(
        F.sum("copies").alias("initial_facts_count"),
        F.count(F.lit(1)).alias("__distinct"),
        *flags,
        *[F.coalesce(F.bool_or(test), F.lit(False)).alias(name) for name, test in known.values()],
    )
    state = state.select(
        "*",
        *[F.lit(None).cast("int").alias(f"round_{i}") for i in range(len(rules))],
        *[F.lit(False).alias(f"added_{i}_{j}") for i, r in enumerate(rules) for j in range(len(r.conclusions))],
        F.lit(True).alias("__open"),
        F.lit(0).alias("iterations"),
    )
    # Only rules that build on conclusions of others can need another round, and each fires once:
    # after so many rounds nothing can change.
    dependent = {i for i, _ in meets}
    for number in range(1, len(dependent) + 3):
        state = state.withColumn("iterations", F.col("iterations") + F.col("__open").cast("int"))
        state = state.withColumn("__grew", F.lit(False))
        for i, rule in enumerate(rules):
            ready = F.col("__open") & F.col(f"round_{i}").isNull()
            for j in range(len(rule.premises)):
                met = F.col(f"met_{i}_{j}")
                for other in sorted(meets.get((i, j), ())):
                    met = met | F.col(f"round_{other}").isNotNull()
                ready = ready & met
            state = state.withColumn("__ready", ready)
            fresh = F.lit(False)
            for j, c in enumerate(rule.conclusions):
                fresh = fresh | ~F.col(known[(c.fact_type, c.entity, c.value)][0])
            state = state.withColumn("__grew", F.col("__grew") | (F.col("__ready") & fresh))
            changes = {f"round_{i}": F.when(F.col("__ready"), F.lit(number)).otherwise(F.col(f"round_{i}"))}
            for j, c in enumerate(rule.conclusions):
                name = known[(c.fact_type, c.entity, c.value)][0]
                changes[f"added_{i}_{j}"] = F.col(f"added_{i}_{j}") | (F.col("__ready") & ~F.col(name))
                changes[name] = F.col(name) | F.col("__ready")
            state = state.withColumns(changes)
        state = state.withColumn("__open", F.col("__open") & F.col("__grew"))
    added = [F.col(f"added_{i}_{j}").cast("int") for i, r in enumerate(rules) for j in range(len(r.conclusions))]
    derived = sum(added[1:], added[0]) if added else F.lit(0)
    fired = [F.col(f"round_{i}") for i in range(len(rules))]
    flag = [F.col(f"added_{i}_{j}") for i, r in enumerate(rules) for j in range(len(r.conclusions))]
    return state.select(
        "case_id",
        "initial_facts_count",
        (F.col("__distinct") + derived).alias("total_facts_count"),
        derived.cast("long").alias("derived_count"),
        "iterations",
        F.array(*fired).alias("fired"),
        F.array(*flag).alias("added"),
    )


def _fired_rows(chained: DataFrame, rules: Sequence[InferenceRule]) -> DataFrame:
    """One row per case and fired rule, with its conclusions and which of them were new."""
    rows, first = [], 0
    for i, rule in enumerate(rules):
        flags = [F.col("added")[first + j] for j in range(len(rule.conclusions))]
        first += len(rule.conclusions)
        conclusions = F.array(
            *[
                F.struct(
                    F.lit(c.fact_id).alias("fact_id"), F.lit(c.fact_type).alias("fact_type"),
                    F.lit(c.entity).alias("entity"), F.lit(c.value).alias("value"),
                    F.lit(c.confidence).alias("confidence"), flags[j].alias("is_new"),
                )
                for j, c in enumerate(rule.conclusions)
            ]
        )
        rows.append(
            F.when(
                F.col("fired")[i].isNotNull(),
                F.struct(
                    F.lit(i).alias("position"), F.col("fired")[i].alias("round"), F.lit(rule.rule_id).alias("rule_id"),
                    F.lit(rule.name).alias("rule_name"), F.lit(rule.category).alias("category"),
                    F.lit(rule.severity).alias("severity"), conclusions.alias("conclusions"),
                ),
            )
        )
    return chained.select(
        "case_id", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("rule")
    ).select("case_id", "rule.*")


def derived_facts(facts: DataFrame, rules: Sequence[InferenceRule] | None = None) -> DataFrame:
    """Facts that the rules added."""
    chosen = list(rules or standard_rules())
    return (
        _fired_rows(chain(counted_facts(facts), chosen), chosen)
        .select("case_id", "rule_id", F.explode("conclusions").alias("c"))
        .where(F.col("c.is_new"))
        .select("case_id", "rule_id", "c.fact_id", "c.fact_type", "c.entity", "c.value", "c.confidence")
    )


def fired_rules(facts: DataFrame, rules: Sequence[InferenceRule] | None = None) -> DataFrame:
    """Log of fired rules. The facts that triggered them are rows of ``rule_triggers``."""
    chosen = list(rules or standard_rules())
    fresh = F.filter("conclusions", lambda c: c["is_new"])

    def named(c: Column) -> Column:
        return F.concat(c["fact_type"], F.lit(":"), c["entity"])

    texts = F.when(
        F.size(fresh) > 0, F.transform(fresh, lambda c: F.concat(named(c), F.lit("="), c["value"]))
    ).otherwise(F.transform("conclusions", named))
    return _fired_rows(chain(counted_facts(facts), chosen), chosen).select(
        "case_id", "round", "position", "rule_id", "rule_name", "category", "severity", texts.alias("derived_facts")
    )


def rule_triggers(facts: DataFrame, rules: Sequence[InferenceRule] | None = None) -> DataFrame:
    """One row per fired rule and triggering fact.

    A hot case can have any number of triggers, so they stay rows instead of a list.
    Conclusions of rules that fired earlier count as facts for the rules after them.
    """
    chosen = list(rules or standard_rules())
    counted = materialize(counted_facts(facts))
    chained = materialize(chain(counted, chosen))
    fired = _fired_rows(chained, chosen)
    hits = F.array(*[F.when(r.trigger(), F.lit(i)) for i, r in enumerate(chosen)])
    base = counted.select("case_id", "fact_id", "fact_type", "entity", "value")
    candidates = base.withColumn("hits", F.filter(hits, lambda h: h.isNotNull())).where(F.size("hits") > 0)
    rounds = chained.select("case_id", "fired")
    given = (
        lookup(candidates, rounds, ["case_id"])
        .select("*", F.explode("hits").alias("position"))
        .where(F.get("fired", F.col("position")).isNotNull())
        .select("case_id", "position", "fact_type", "entity", "value")
    )
    later = (
        fired.select("case_id", F.col("position").alias("from_rule"), F.col("round").alias("from_round"), F.explode("conclusions").alias("c"))
        .where(F.col("c.is_new"))
        .select("case_id", "from_rule", "from_round", "c.fact_type", "c.entity", "c.value")
        .withColumn("position", F.explode(F.filter(hits, lambda h: h.isNotNull())))
        .join(fired.select("case_id", "position", "round"), ["case_id", "position"])
        .where(F.struct("from_round", "from_rule") < F.struct("round", "position"))
        .select("case_id", "position", "fact_type", "entity", "value")
    )
    names = F.array(*[F.lit(r.rule_id) for r in chosen])
    return given.unionByName(later).select(
        "case_id",
        names[F.col("position")].alias("rule_id"),
        F.concat(F.col("fact_type"), F.lit(":"), F.col("entity")).alias("trigger"),
        "value",
    )


def inference_summary(facts: DataFrame, rules: Sequence[InferenceRule] | None = None) -> DataFrame:
    """Counts, iterations and an explanation per case."""
    chained = chain(counted_facts(facts), rules)
    fired = F.size(F.filter("fired", lambda r: r.isNotNull()))
    return chained.withColumn("fired_rules_count", fired.cast("long")).select(
        "case_id",
        "initial_facts_count",
        "total_facts_count",
        F.col("derived_count").alias("derived_facts_count"),
        "fired_rules_count",
        "iterations",
        F.concat(
            F.lit("Forward Chaining completed in "), F.col("iterations").cast("string"), F.lit(" iteration(s). Fired "),
            F.col("fired_rules_count").cast("string"), F.lit(" rule(s) and derived "),
            F.col("derived_count").cast("string"), F.lit(" new threat fact(s) from "),
            F.col("initial_facts_count").cast("string"), F.lit(" initial evidence fact(s)."),
        ).alias("explanation"),
    )

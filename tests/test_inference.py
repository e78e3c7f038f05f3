"""Facts and forward chaining against hand-made cases and a plain-Python loop."""

import random

import pytest
from pyspark.sql import functions as F

from casewise.operators import inference as I
from conftest import rows
from test_graph import normalized


def facts(spark, *items, case=1):
    return I.custom_facts(spark, [{"case_id": case, "fact_type": t, "entity": e, "value": v} for t, e, v in items])


@pytest.mark.parametrize("items,fired", [
    ([("AUTH_FAILURE_BURST", "S", "3_failures")], ["RULE_01_BRUTE_FORCE"]),
    ([("PROCESS_CREATE", "h", "PowerShell.exe"), ("WMI_EXECUTION", "h", "x")], ["RULE_02_WMI_LATERAL"]),
    ([("PROCESS_CREATE", "h", "notepad"), ("WMI_EXECUTION", "h", "x")], []),
    ([("SUSPICIOUS_PROCESS_EXECUTION", "h", "cmd.exe")], []),
    ([("SHADOW_COPY_DELETION", "h", "x")], ["RULE_03_RANSOMWARE"]),
    ([("NOTE", "h", "ran VSSADMIN")], ["RULE_03_RANSOMWARE"]),
    ([("MASS_FILE_RENAME", "h", "x")], []),
])
def test_each_rule(spark, items, fired):
    given = facts(spark, *items)
    assert [r["rule_id"] for r in I.fired_rules(given).orderBy("position").collect()] == fired
    row = I.inference_summary(given).first()
    assert (row["iterations"], row["derived_facts_count"]) == (2 if fired else 1, 2 * len(fired))


def test_known_conclusions(spark):
    """A rule whose conclusions are already known fires once and is logged without values."""
    known = [("SHADOW_COPY_DELETION", "h", "x"), ("CRITICAL_THREAT", "RANSOMWARE_ACTIVITY", "T1490"),
             ("INCIDENT_HYPOTHESIS", "SYSTEM_DESTRUCTIVE_ATTACK", "CRITICAL")]
    row = I.fired_rules(facts(spark, *known)).first()
    assert row["derived_facts"] == ["CRITICAL_THREAT:RANSOMWARE_ACTIVITY", "INCIDENT_HYPOTHESIS:SYSTEM_DESTRUCTIVE_ATTACK"]
    assert I.derived_facts(facts(spark, *known)).count() == 0
    assert I.inference_summary(facts(spark, *known)).first()["iterations"] == 1


def test_facts_of_events(spark):
    events = normalized(
        spark,
        *[{"hostname": "FS-01", "username": "admin", "action": "AUTH_FAILED"}] * 3,
        {"hostname": "FS-01", "username": "admin", "process_name": "vssadmin.exe", "command_line": "vssadmin delete shadows"},
        {"hostname": "FS-01", "username": None, "process_name": "WmiPrvSE.exe", "action": "ACCESS_DENIED"},
    )
    custom = facts(spark, ("HIGH_ENTROPY_FILE_WRITE", "host:FS-01", "True"))
    got = I.facts_from_events(events, numbered=True, custom=custom)
    assert rows(got, "fact_id", "fact_type", "entity", "value") == sorted([
        ("DB_F_1", "AUTH_FAILURE", "user:admin", "AUTH_FAILED"), ("DB_F_2", "AUTH_FAILURE", "user:admin", "AUTH_FAILED"),
        ("DB_F_3", "AUTH_FAILURE", "user:admin", "AUTH_FAILED"),
        ("DB_F_4", "SHADOW_COPY_DELETION", "host:FS-01", "vssadmin delete shadows"),
        ("DB_F_5", "AUTH_FAILURE", "user:unknown", "ACCESS_DENIED"), ("DB_F_6", "WMI_EXECUTION", "host:FS-01", "WmiPrvSE.exe"),
        ("DB_F_7", "AUTH_FAILURE_BURST", "AUTHENTICATION_SERVICE", "4_failures"),
        ("CUSTOM_F_1", "HIGH_ENTROPY_FILE_WRITE", "host:FS-01", "True"),
    ])
    row = I.inference_summary(got).first()
    assert (row["initial_facts_count"], row["total_facts_count"], row["fired_rules_count"]) == (8, 10, 2)
    hits = rows(I.rule_triggers(got), "rule_id", "trigger")
    assert hits == [
        ("RULE_01_BRUTE_FORCE", "AUTH_FAILURE_BURST:AUTHENTICATION_SERVICE"),
        ("RULE_03_RANSOMWARE", "HIGH_ENTROPY_FILE_WRITE:host:FS-01"), ("RULE_03_RANSOMWARE", "SHADOW_COPY_DELETION:host:FS-01")]


def kind(*names):
    return F.col("fact_type").isin(*names)


def rule(name, needs, gives):
    return I.InferenceRule(name, name, "C", "LOW", tuple(kind(n) for n in needs), tuple(I.Conclusion(f"F_{g}", g, "e", "v", 0.5) for g in gives))


def by_hand(start, rules):
    known, fired, passes, grew = set(start), {}, 0, True
    while grew and passes < 50:
        passes += 1
        grew = False
        for name, needs, gives in rules:
            if name in fired or not all(n in known for n in needs):
                continue
            new = [g for g in gives if g not in known]
            known |= set(new)
            grew = grew or bool(new)
            fired[name] = (passes, sorted(new))
    return known, fired, passes


@pytest.mark.parametrize("seed", range(4))
def test_chained_rules_against_a_loop(spark, seed):
    rng = random.Random(seed)
    letters = "ABCDEFGH"
    specs = [(f"R{i}", rng.sample(letters, rng.choice([1, 2])), rng.sample(letters, rng.choice([1, 2]))) for i in range(5)]
    rules = [rule(*s) for s in specs]
    starts = {case: rng.sample(letters, 2) for case in range(4)}
    given = I.custom_facts(spark, [{"case_id": c, "fact_type": t, "entity": "e", "value": "v"} for c, ts in starts.items() for t in ts])
    summary = {r["case_id"]: r for r in I.inference_summary(given, rules).collect()}
    fired = {(r["case_id"], r["rule_id"]): r["round"] for r in I.fired_rules(given, rules).collect()}
    new = {}
    for r in I.derived_facts(given, rules).collect():
        new.setdefault((r["case_id"], r["rule_id"]), []).append(r["fact_type"])
    triggers = {(r["case_id"], r["rule_id"], r["trigger"]) for r in I.rule_triggers(given, rules).collect()}
    for case, start in starts.items():
        known, log, passes = by_hand(start, specs)
        assert (summary[case]["total_facts_count"], summary[case]["iterations"]) == (len(known), passes)
        assert {n: r for (c, n), r in fired.items() if c == case} == {n: p for n, (p, _) in log.items()}
        for name, (_, added) in log.items():
            assert sorted(new.get((case, name), [])) == added
        for name, needs, _ in specs:
            want = {(case, name, f"{n}:e") for n in needs} if name in log else set()
            assert {t for t in triggers if t[:2] == (case, name)} == want

"""Syslog lines: splitting, classification and field extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.text import contains_any, found


_MARK = "\x01"


def split_line(line: Column, pattern: str = X.SYSLOG_LINE) -> Column:
    """Struct of the parts of a syslog line; ``matched`` is false for other lines.

    The line is rewritten once with a mark between its parts and then split, instead of running
    the pattern again for every part.
    """
    names = ["month", "day", "clock", "host", "process", "pid", "message"]
    marked = F.regexp_replace(line, pattern, _MARK.join(f"${i}" for i in range(1, len(names) + 1)))
    parts = F.split(marked, _MARK, len(names))
    fields = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)]
    return F.struct(line.rlike(pattern).alias("matched"), *fields)


def message_class(message: Column) -> Column:
    """``failure``, ``success``, ``privilege`` or ``other``; the tests are case-sensitive."""
    return (
        F.when(contains_any(message, X.SYSLOG_FAILURE), "failure")
        .when(contains_any(message, X.SYSLOG_SUCCESS), "success")
        .when(contains_any(message, X.SYSLOG_PRIVILEGE), "privilege")
        .otherwise("other")
    )


def class_event_type(kind: Column) -> Column:
    return (
        F.when(kind == "failure", "AuthFailure")
        .when(kind == "success", "AuthSuccess")
        .when(kind == "privilege", "PrivilegeEscalation")
        .otherwise("SyslogMessage")
    )


def class_severity(kind: Column) -> Column:
    return (
        F.when(kind == "failure", "critical")
        .when(kind == "success", "high")
        .when(kind == "privilege", "medium")
        .otherwise("low")
    )


def message_user(kind: Column, message: Column) -> Column:
    user = F.when(kind == "failure", found(message, X.SYSLOG_FAILURE_USER, 2)).when(
        kind == "success", found(message, X.SYSLOG_SUCCESS_USER, 1)
    )
    return F.coalesce(user, F.lit("root"))


def message_address(kind: Column, message: Column) -> Column:
    return F.when(kind.isin("failure", "success"), found(message, X.SYSLOG_ADDRESS, 1))


# ---- descriptive profile -------------------------------------------------------


def descriptive_severity(message: Column) -> Column:
    lowered = F.lower(message)
    chosen = F.lit("low")
    for name, words in reversed(X.DESCRIPTIVE_SEVERITY):
        chosen = F.when(contains_any(lowered, words), name).otherwise(chosen)
    return chosen


def descriptive_event_type(process: Column, message: Column) -> Column:
    p, m = F.lower(process), F.lower(message)
    ssh = (
        F.when(m.contains("accepted"), "SSH Login Success")
        .when(contains_any(m, ["failed", "invalid"]), "SSH Login Failure")
        .otherwise("SSH Event")
    )
    return (
        F.when(p.contains("sshd"), ssh)
        .when(p.contains("sudo"), "Sudo Command")
        .when(p == "su", "Switch User")
        .when(contains_any(p, ["useradd", "adduser"]), "User Created")
        .when(p.contains("userdel"), "User Deleted")
        .when(p.contains("passwd"), "Password Changed")
        .when(p.contains("cron"), "Cron Job")
        .otherwise("System Event")
    )


def descriptive_user(message: Column) -> Column:
    return F.coalesce(*[found(message, pattern, 1) for pattern in X.DESCRIPTIVE_USER_PATTERNS])


def descriptive_suspicion(message: Column) -> Column:
    return contains_any(F.lower(message), X.SUSPICIOUS_WORDS)



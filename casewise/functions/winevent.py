"""Windows event fields: names, severities and data lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.text import first_present, present


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def id_severity(event_id: Column) -> Column:
    return (
        F.when(event_id.isin(X.WIN_CRITICAL_IDS), "critical")
        .when(event_id.isin(X.WIN_HIGH_IDS), "high")
        .otherwise("low")
    )


def event_name(event_id: Column) -> Column:
    """Readable name of an event id, else ``Event ID n``."""
    text = F.coalesce(event_id, F.lit("None"))
    return F.coalesce(_lookup(text, X.WIN_EVENT_NAMES), F.concat(F.lit("Event ID "), text))


def level_severity(level: Column) -> Column:
    return F.coalesce(_lookup(F.coalesce(level, F.lit("")), X.WIN_LEVEL_SEVERITY), F.lit("low"))


def last_data_value(data: Column, names: list[str]) -> Column:
    """Value of the last data pair whose name matches one of ``names`` regardless of case.

    ``data`` is an array of structs ``(name, value)``.
    """
    hits = F.filter(data, lambda d: F.lower(d["name"]).isin(names))
    return F.try_element_at(hits, F.lit(-1))["value"]


def named_data_value(data: Column, name: str) -> Column:
    """Value of the last data pair with exactly this name."""
    return F.try_element_at(F.filter(data, lambda d: d["name"] == name), F.lit(-1))["value"]


def data_user(data: Column) -> Column:
    return first_present([last_data_value(data, X.WIN_USER_FIELDS)], "SYSTEM")


def data_address(data: Column) -> Column:
    return last_data_value(data, X.WIN_IP_FIELDS)


def data_process(data: Column) -> Column:
    return last_data_value(data, X.WIN_PROCESS_FIELDS)


def event_description(event_id: Column, data: Column) -> Column:
    """``type — User: u`` with `` from host`` when a host is named."""
    user = F.coalesce(
        present(named_data_value(data, "SubjectUserName")),
        named_data_value(data, "TargetUserName"),
        F.lit("Unknown"),
    )
    host = F.coalesce(
        present(named_data_value(data, "WorkstationName")), present(named_data_value(data, "IpAddress"))
    )
    return F.concat(
        event_name(event_id),
        F.lit(" — User: "),
        user,
        F.coalesce(F.concat(F.lit(" from "), host), F.lit("")),
    )

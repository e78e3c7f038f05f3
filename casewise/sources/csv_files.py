"""Reader of CSV files with a header line."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise import taxonomy as X
from casewise.functions.events import pick_alias, universal_event
from casewise.functions.timestamps import iso_to_utc
from casewise.sources.files import Origin, is_folder, literal_path, read_lines, reader, with_identity


def csv_events(
    rows: DataFrame, available: Mapping[str, Column], record: Column, origin: Origin, profile: str = "standard"
) -> DataFrame:
    """Events from CSV rows: ``available`` has the fields by lower-case name, ``record`` the row as JSON text."""
    chosen = {"standard": _standard_fields, "wide": _wide_fields}[profile](available, record)
    return universal_event(rows, {**chosen, "raw_data": F.parse_json(record)}, origin.ingest_time())


def _standard_fields(available: Mapping[str, Column], record: Column) -> dict[str, Column]:
    trimmed = {name: F.trim(column) for name, column in available.items()}
    names, pick = X.CSV_ALIASES, lambda field, otherwise=None: pick_alias(trimmed, X.CSV_ALIASES[field], otherwise)
    fields = {name: pick(name) for name in names if name not in ("timestamp", "description")}
    return {
        **fields,
        "timestamp": iso_to_utc(pick("timestamp")),
        "event_type": pick("event_type", "CSVRecord"),
        "severity": pick("severity", "low"),
        "source": F.lit("CSVFile"),
        "description": F.coalesce(pick("description"), record),
    }


def _wide_fields(available: Mapping[str, Column], record: Column) -> dict[str, Column]:
    """The wide profile picks one column per field from the header, even where it is empty."""

    def named(field: str) -> Column:
        found = [available[n] for n in X.CSV_WIDE_ALIASES[field] if n in available]
        return found[0] if found else F.lit(None).cast("string")

    first = [
        F.concat(F.lit(f"{name}="), F.coalesce(column, F.lit("None")))
        for name, column in list(available.items())[:5]
    ]
    has_type = any(n in available for n in X.CSV_WIDE_ALIASES["event_type"])
    return {
        "timestamp": iso_to_utc(named("timestamp")),
        "user": named("user"),
        "host": named("host"),
        "ip_address": named("ip_address"),
        "event_type": named("event_type") if has_type else F.lit("Log Entry"),
        "severity": F.lit("low"),
        "source": F.lit("CSV Log"),
        "description": F.concat_ws(" | ", *first),
    }


def header_names(header: str) -> list[str] | None:
    """Column names of a header line; None when they need Spark's own treatment (empty, repeated, marked)."""
    names = next(csv.reader([header]), [])
    plain = all(names) and len({n.lower() for n in names}) == len(names) and not header.startswith("\ufeff")
    return names if plain else None


def _scan(
    spark: SparkSession, path, glob: str | None, multi_line: bool, base: str | None, names: list[str] | None
) -> DataFrame:
    source = reader(spark, glob)
    if names:
        source = source.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    if base:
        source = source.option("basePath", base)
    return (
        source.option("header", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .csv(path)
    )


def read_csv_events(
    spark: SparkSession,
    path,
    origin: Origin,
    profile: str = "standard",
    glob: str | None = None,
    multi_line: bool = True,
    base: str | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """Events of CSV files that share one header; files with another header are refused by the scan.

    ``multi_line`` allows line breaks inside quoted fields, which keeps a file in one task.
    Turn it off for logs with one record per line, so that large files are split. ``base`` is the
    folder below which case_id=... and evidence_id=... folders count, when ``path`` lists files;
    ``names`` are the header's names where they are known, which saves the pass that infers them.
    """
    scan = _scan(spark, path, glob, multi_line, base, names)
    names = [f.name for f in scan.schema.fields if f.name not in ("case_id", "evidence_id")]
    rows = with_identity(scan, origin)
    available = {name.strip().lower().lstrip("﻿"): F.col(f"`{name}`") for name in names}
    record = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))
    return csv_events(rows, available, record, origin, profile)


def header_groups(spark: SparkSession, path, origin: Origin, glob: str | None = None) -> dict[str, list[str]]:
    """Files by header line. The list is a part of the file listing that the driver holds anyway."""
    heads = (
        read_lines(spark, path, origin, glob)
        .where(F.trim("line") != "")
        .groupBy("path")
        .agg(F.min_by("line", "seq").alias("header"))
    )
    groups: dict[str, list[str]] = {}
    for row in heads.toLocalIterator():
        groups.setdefault(row["header"], []).append(literal_path(row["path"]))
    return groups


def read_mixed_csv_events(
    spark: SparkSession, path, origin: Origin, profile: str = "standard", glob: str | None = None, multi_line: bool = True
) -> DataFrame | None:
    """Events of CSV files with different headers: one scan per distinct header, then a union."""
    base = path if isinstance(path, str) and is_folder(spark, path) else None
    parts = [
        read_csv_events(spark, files, origin, profile, None, multi_line, base, header_names(header))
        for header, files in sorted(header_groups(spark, path, origin, glob).items())
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def map_fields(fields: Column, aliases: Mapping[str, list[str]]) -> dict[str, Column]:
    """The aliased fields of a ``map<string,string>`` with lower-case keys, by name."""
    names = dict.fromkeys(n for group in aliases.values() for n in group)
    return {name: F.coalesce(fields.getItem(name), F.lit("")) for name in names}



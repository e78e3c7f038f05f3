"""Small string helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """Null for an empty string; the text is not trimmed."""
    return F.nullif(value, F.lit(""))


def first_present(values: Iterable[Column], otherwise: str | None = None) -> Column:
    picked = [present(v) for v in values]
    if otherwise is not None:
        picked.append(F.lit(otherwise))
    if not picked:
        return F.lit(None).cast("string")
    return F.coalesce(*picked)


def contains_any(value: Column, words: Iterable[str]) -> Column:
    """True when one of the words occurs; null text counts as no hit."""
    hit = F.lit(False)
    for word in words:
        hit = hit | value.contains(word)
    return F.coalesce(hit, F.lit(False))


def found(text: Column, pattern: str, group: int) -> Column:
    """A regular-expression group, null when there is no match."""
    return present(F.regexp_extract(text, pattern, group))


def cut(value: Column, limit: int) -> Column:
    return F.substring(value, 1, limit)


def like_any(columns: Iterable[Column], needle: str, escape: bool = False) -> Column:
    """Case-insensitive substring search over several columns.

    ``%`` and ``_`` in the needle are wildcards unless ``escape`` is set.
    """
    text = needle
    if escape:
        for mark in ("\\", "%", "_"):
            text = text.replace(mark, "\\" + mark)
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(column.ilike(f"%{text}%"), F.lit(False))
    return hit

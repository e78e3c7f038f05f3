"""Time conversion. The session time zone must be UTC (see ``session.configure``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise.taxonomy import MONTHS

ISO_TEXT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?$"
)


def iso_to_utc(text: Column) -> Column:
    """ISO date or date-time text to a UTC timestamp; text without an offset is UTC; bad text is null."""
    clean = F.replace(F.replace(text, F.lit("Z"), F.lit("+00:00")), F.lit(","), F.lit("."))
    return F.when(text.rlike(ISO_TEXT), F.try_to_timestamp(clean))


def epoch_to_utc(seconds: Column) -> Column:
    """Seconds since 1970 (whole or fractional) to a timestamp."""
    return F.timestamp_micros((seconds.cast("double") * 1_000_000).cast("long"))


def to_utc(value: Column, kind: str, ingest_ts: Column) -> Column:
    """Any of the accepted time forms to UTC, with ``ingest_ts`` where it is missing or bad.

    ``kind`` is ``iso`` for text, ``epoch`` for numbers, ``timestamp`` for typed columns.
    """
    converted = {
        "iso": iso_to_utc,
        "epoch": epoch_to_utc,
        "timestamp": lambda c: c.cast("timestamp"),
    }[kind](value)
    return F.coalesce(converted, ingest_ts)


def syslog_time(month: Column, day: Column, clock: Column, year: Column | int) -> Column:
    """``Mon d HH:MM:SS`` with a year given by the caller; unknown months count as January.

    An impossible date gives null, so that the row is kept.
    """
    number = F.lit(1)
    for position, name in reversed(list(enumerate(MONTHS, start=1))):
        number = F.when(month == name, position).otherwise(number)
    year_column = F.lit(year) if isinstance(year, int) else year
    text = F.format_string("%04d-%02d-%02d ", year_column.cast("int"), number, day.try_cast("int"))
    return F.try_to_timestamp(F.concat(text, clock), F.lit("yyyy-MM-dd HH:mm:ss"))


def utc_text(timestamp: Column, separator: str = " ") -> Column:
    """``yyyy-MM-dd HH:mm:ss[.ffffff]+00:00``; the fraction appears only when it is not zero."""
    day = f"yyyy-MM-dd'{separator}'HH:mm:ss"
    whole = F.date_trunc("second", timestamp) == timestamp
    return F.concat(
        F.when(whole, F.date_format(timestamp, day)).otherwise(F.date_format(timestamp, f"{day}.SSSSSS")),
        F.lit("+00:00"),
    )

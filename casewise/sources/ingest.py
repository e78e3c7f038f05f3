"""Reading a whole evidence folder: every file goes to the reader of its format."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.text import contains_any
from casewise.sources.archive import read_archive_events
from casewise.sources.csv_files import read_mixed_csv_events
from casewise.sources.files import Origin, any_case_glob, read_lines
from casewise.sources.json_files import read_json_events
from casewise.sources.line_logs import syslog_events, text_events
from casewise.sources.winevent_xml import read_winevent_xml
from casewise.sources.xml_files import read_xml_events

Reader = Callable[[SparkSession, object, Origin, int], DataFrame]


ANY_OTHER = "*"


def _line_logs(spark: SparkSession, path, origin: Origin, year: int) -> DataFrame:
    lines = read_lines(spark, path, origin, any_case_glob(X.LINE_LOG_EXTENSIONS))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    is_syslog = contains_any(name, X.SYSLOG_NAME_HINTS)
    return syslog_events(lines.where(is_syslog), origin, year).unionByName(
        text_events(lines.where(~is_syslog), origin)
    )


def _other_files(spark: SparkSession, path, origin: Origin, year: int) -> DataFrame:
    """Lines of the files that no other pattern matches, such as ``messages``; Spark does not open the rest."""
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    known = [F.coalesce(name.rlike(_pattern(p)), F.lit(False)) for p in READERS if p != ANY_OTHER]
    return text_events(read_lines(spark, path, origin, where=~reduce(Column.__or__, known)), origin)


def _pattern(glob: str) -> str:
    """The regular expression of a file-name pattern with ``*``, ``?``, ``[...]`` and ``{a,b}``."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "[":
            end = glob.index("]", at)
            out, at = out + glob[at : end + 1], end
        elif c in "{}":
            depth += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        else:
            out += {"*": ".*", "?": ".", ",": "|" if depth else ","}.get(c, re.escape(c))
        at += 1
    return f"^{out}$"


# Reader per file-name pattern; ``register_reader`` adds to it.
READERS: dict[str, Reader] = {
    any_case_glob(X.LINE_LOG_EXTENSIONS): _line_logs,
    any_case_glob(["csv"]): lambda s, p, o, y: read_mixed_csv_events(s, p, o, glob=any_case_glob(["csv"])),
    any_case_glob(["json"]): lambda s, p, o, y: read_json_events(s, p, o, glob=any_case_glob(["json"])),
    any_case_glob(["evtx"]): lambda s, p, o, y: read_winevent_xml(s, p, o, glob=any_case_glob(["evtx"])),
    any_case_glob(["xml"]): lambda s, p, o, y: read_xml_events(s, p, o, glob=any_case_glob(["xml"])),
    any_case_glob(["zip"]): lambda s, p, o, y: read_archive_events(s, p, o, y, glob=any_case_glob(["zip"])),
    ANY_OTHER: _other_files,
}


def register_reader(pattern: str, read: Reader) -> None:
    """Add a reader ``(spark, path, origin, year) -> EVENT frame`` for files matching the pattern."""
    READERS[pattern] = read


def read_evidence(
    spark: SparkSession, path, origin: Origin, year: int, patterns: list[str] | None = None
) -> DataFrame:
    """Events of all evidence files under the path, in one frame."""
    chosen = patterns or list(READERS)
    parts = [READERS[p](spark, path, origin, year) for p in chosen]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])

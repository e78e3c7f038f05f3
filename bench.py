"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2; the best run of each query counts, ``first_run`` has the first).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from casewise.plans import adapters, queries  # noqa: E402
from casewise.session import local_session  # noqa: E402
from casewise.sources.files import Origin  # noqa: E402
from casewise.sources.line_logs import read_syslog_events  # noqa: E402

HEADLINE = [
    "normalize_counts",
    "normalize_rows",
    "syslog_roundtrip",
    "timeline_sequence",
    "timeline_range",
    "dashboard_stats",
    "correlate_events",
    "detect_alerts",
    "graph_nodes",
    "graph_edges",
    "graph_stats",
    "connected_components",
    "cheapest_path",
    "validate_summary",
    "inference_summary",
    "case_context",
]


def syslog_file(spark, folder: str, target: str) -> str:
    """Syslog files written from the order lines, about 100 MB at the default scale."""
    line = F.concat(
        F.date_format("l_shipdate", "MMM d HH:mm:ss"),
        F.lit(" host-"),
        F.col("l_suppkey").cast("string"),
        F.expr(
            "CASE l_linenumber % 3 WHEN 0 THEN ' sshd[7]: Failed password for user' "
            "WHEN 1 THEN ' sshd[7]: Accepted password for user' ELSE ' cron: job' END"
        ),
        F.col("l_partkey").cast("string"),
        F.lit(" from 10.0.0.7 port 22 ssh2 "),
        F.repeat(F.lit("x"), F.lit(80)),
    )
    adapters.table(spark, folder, "lineitem").select(line.alias("value")).write.text(target)
    return target


def laid_out(spark, folder: str, shared: str, files: int) -> str:
    """The tables that the queries read, each in as many files as there are cores, as a large table would be."""
    target = f"{shared}/tables"
    for name in ("events", "documents", "customer", "orders", "pages", "lineitem"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{target}/{name}.parquet")
    return target


def timed(action, runs: int) -> list[float]:
    """Seconds of every run; the first one also compiles code."""
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(round(time.perf_counter() - start, 3))
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    shared = tempfile.mkdtemp(prefix="casewise-bench-")
    spark = local_session(
        cpus,
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        app="casewise-bench",
        **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": shared},
    )
    seconds, first = {}, {}
    tables = laid_out(spark, folder, shared, spark.sparkContext.defaultParallelism)

    def consume(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    for name in HEADLINE:
        taken = timed(lambda: consume(queries.QUERIES[name](spark, tables)), runs)
        seconds[name], first[name] = min(taken), taken[0]
        print(name, *taken, file=sys.stderr, flush=True)
    logs = syslog_file(spark, folder, f"{shared}/logs")
    size = sum(os.path.getsize(os.path.join(logs, f)) for f in os.listdir(logs)) / 1e6
    taken = timed(lambda: consume(read_syslog_events(spark, logs, Origin(case_id=1), 2024)), runs)
    seconds["syslog_file_parse"], first["syslog_file_parse"] = parse, _ = min(taken), taken[0]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
                "parsed_mb": round(size, 1),
                "parse_mb_per_sec": round(size / parse, 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

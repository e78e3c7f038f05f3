"""The driver's entry points in a session without any of the library's settings."""

import os
import subprocess
import sys

import pytest

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.entry(spark).count(), spark.conf.get("spark.sql.session.timeZone"))
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not there")
def test_entry_in_a_plain_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-c", CODE.format(root=root)], capture_output=True, text=True, timeout=180
    )
    assert "rows 72 UTC" in done.stdout, done.stderr[-2000:]

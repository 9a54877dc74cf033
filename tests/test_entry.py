"""The entry file works where workers cannot import the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as registered
sys.path.remove(sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("score_velocity", "decode_fields", "prepare_images", "embed_text", "vector_moments", "euler_snapshots"):
    assert registered.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_functions_travel_without_the_package(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in run.stdout, run.stderr[-2000:]

"""The entry file in a session of its own."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
known = entry.queries()
for _ in range(2):
    print("ROWS", known["appendix_sections"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package(tmp_path):
    """A driver that knows the repository by its own path alone sends it to the Python workers."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ROWS") == 2

"""Python functions must reach the workers from any working directory, without the repository on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from holdfast.plans.neighbours import nearest_points, weighted_points
points = spark.range(40).select((F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
print("FOUND", nearest_points(weighted_points(points, ["a", "b"]), 2, 3, 10).count())
"""


def test_functions_reach_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 40" in done.stdout, done.stderr[-2000:]

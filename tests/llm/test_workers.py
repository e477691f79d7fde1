"""Every query of the subpackage runs in a session whose workers do not have the repository on their path."""

import os
import subprocess
import sys

import pytest

from holdfast.llm.queries import QUERIES
from tests.conftest import SF_DIR

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()[sys.argv[1]](spark, {SF_DIR!r}).count())
"""


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_runs_from_another_folder(tmp_path, name):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, name], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS " in done.stdout, done.stderr[-2000:]

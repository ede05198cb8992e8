"""The driver's functions in a process of their own, before any session exists."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
SCRIPT = """
import __spark_entry__ as e
from pyspark import SparkContext
queries, oracles = e.queries(), e.oracle_sql()
assert set(oracles) <= set(queries) and len(queries) > 250, (len(queries), set(oracles) - set(queries))
assert SparkContext._active_spark_context is None
"""


def test_queries_and_oracles_load_without_a_session():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr

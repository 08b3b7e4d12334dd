"""Everything is imported before there is a session, as the driver does it; conftest makes one first, so these run in a process of their own."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
IMPORTS = """
import importlib, pkgutil
import __spark_entry__ as entry, veriframe
for m in pkgutil.walk_packages(veriframe.__path__, "veriframe."):
    importlib.import_module(m.name)
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
print(*sorted(entry.queries()))
assert entry.oracle_sql().keys() <= entry.queries().keys()
"""
ENTRY = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.entry(spark).count() > 0
spark.stop()
"""


def run(code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)


def test_queries_are_read_without_a_session():
    done = run(IMPORTS)
    assert done.returncode == 0, done.stderr[-2000:]
    names = done.stdout.split()
    assert {"rule_names", "rule_disclosures", "latest_event_per_user", "pipeline", "op1_html_extraction", "op13_structure_repair"} <= set(names)


def test_entry_runs_in_a_session_made_after_it():
    done = run(ENTRY)
    assert done.returncode == 0, done.stderr[-2000:]

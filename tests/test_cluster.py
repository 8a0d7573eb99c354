import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys, time
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,1,768]").config("spark.driver.memory", "768m").config("spark.executor.memory", "768m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate())
import __spark_entry__ as entry
found = entry.queries()
print("rows", entry.entry(spark).count(), found["reflow"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_executors_find_the_package_without_a_python_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), f"file://{tmp_path}/warehouse"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, f"{done.stderr[:3000]} ... {done.stderr[-3000:]}"
    assert done.stdout.split()[-3:-1] == ["rows", "25"] and int(done.stdout.split()[-1]) > 0

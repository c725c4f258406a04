"""Corpus queries whose tasks run Python find this package in a process of its own, started from an empty folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from corpusloom.session import session
spark = session("fresh", 4)
spark.sparkContext.setLogLevel("ERROR")
known = __spark_entry__.queries()
for name in sys.argv[3:]:
    print(name, known[name](spark, sys.argv[2]).count(), flush=True)
"""


def test_queries_from_an_empty_folder(sf_dir, tmp_path):
    names = ["op5_sharding", "op12_periodic_runs"]
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "SPARK", "PYSPARK_GATEWAY"))}
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, sf_dir, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [x.split()[0] for x in run.stdout.splitlines() if x.split() and x.split()[0] in names] == names, run.stderr[-3000:]

"""The driver imports __spark_entry__ from elsewhere with its own session: Python
UDFs must still run (their code ships by value, nothing is installed on workers)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, '__spark_entry__.py')!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
q = E.queries()
assert E.entry(spark).count() > 0
for k in ["extract_title", "chi_square", "score_text"]:
    assert q[k](spark, "/root/testdata/sf0.001").count() > 0, k
print("ISOLATED-OK")
"""


def test_queries_run_from_foreign_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as d:
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env, capture_output=True, text=True,
                             timeout=600)
    assert "ISOLATED-OK" in out.stdout, out.stderr[-3000:]


def test_local_fs_path_forms():
    from revlens.session import is_local_path, local_fs_path
    assert local_fs_path("file:/tmp/a") == "/tmp/a"
    assert local_fs_path("file:///tmp/a") == "/tmp/a"
    assert local_fs_path("/tmp/a") == "/tmp/a"
    assert is_local_path("file:/x") and is_local_path("/x") and not is_local_path("s3a://b/x")

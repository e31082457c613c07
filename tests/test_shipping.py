"""The package need not be on the executors: it's on the driver's path only, and Python workers start elsewhere."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://{tmp}/shared"}}).getOrCreate()
import __spark_entry__ as entry
{body}
spark.stop()
"""


def alone(tmp_path, body):
    """Runs a script from an empty folder, with the repository on no path but the driver's own."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if path := [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and not os.path.abspath(p).startswith(ROOT)]:
        env["PYTHONPATH"] = ":".join(path)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, tmp=tmp_path, body=body)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]


def test_queries_and_scans_run_where_the_package_is_not(tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("# a\nrunning words\n")
    alone(tmp_path, f"""
for name in ("bm25_porter", "chunk_documents", "job1_change_feed"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
from quillspark.functions.embed import hash_embedder
from quillspark.plans.engine import ingest
from quillspark.sources.snapshot import Snapshots
from quillspark.sources.vaults import walk
assert ingest(Snapshots(spark, "file://{tmp_path}/index"), walk(spark, "v", "{tmp_path}/notes"), "t", hash_embedder(4), 4).first()["inserted"] == 1
""")

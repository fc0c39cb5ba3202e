import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "judge_balance" in q and set(o) <= set(q) and not [x for x in q if x.startswith("op") or x == "pipeline"], sorted(q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.entry(spark).count())
"""


def test_rest_works_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "metastore_db"))
    for gone in ("ratingmill/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    for pipeline_too in (False, True):
        if pipeline_too:
            (copy / "corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]

"""The library without its training-data part: the entry imports and a query runs."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(
        ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json")
    )
    assert not (copy / "webcorpus" / "llm").exists() and not (copy / "tests" / "llm").exists()
    script = (
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "names = e.queries()\n"
        "assert 'pipeline' not in names and not any(n.startswith('op') for n in names), names\n"
        "spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate())\n"
        "print(e.entry(spark).count())\n"
        "spark.stop()\n"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.strip().splitlines()[-1]) >= 0

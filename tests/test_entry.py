import shutil
import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_without_the_corpus_operators(tmp_path):
    """With the corpus folders and the pipeline gone the entry still imports and lists the other queries."""
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, copy, ignore=skip)
    said = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q); print(*q)"
    out = subprocess.run([sys.executable, "-c", said], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    assert "hybrid_search" in out.stdout and "pipeline" not in out.stdout.split() and "op1_" not in out.stdout

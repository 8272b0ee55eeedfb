"""The driver contract with and without the training-text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def test_entry_without_the_text_subpackage(tmp_path):
    there = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, there, ignore=skip)
    assert not (there / "cartoloom" / "llm").exists() and (there / "corpus_pipeline.py").exists()
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=there, env={**os.environ, "PYTHONPATH": str(there)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1:] == ["False", "True"]

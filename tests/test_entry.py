"""The entry points, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') for n in q if n[2:3].isdigit()), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=there, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(there)}, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1:] == ["True", "False", "False"]


def test_flagship_gives_rows(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10

"""The entry points, with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_imports_without_the_text_operators(tmp_path, left):
    at = tmp_path / "repo"
    gone = [".git", "llm", "__pycache__", "spark-warehouse", *([] if left == "pipeline" else ["corpus_pipeline.py"])]
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(*gone))
    if left == "empty folder":
        (at / "strandline" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, check=True)

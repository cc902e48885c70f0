"""The contract of the entry module, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']"
    subprocess.run(
        [sys.executable, "-c", code],
        cwd=copy,
        check=True,
        env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)},
        timeout=120
    )

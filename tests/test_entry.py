"""The entry points without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

PROBE = """
import __spark_entry__ as e
names = e.queries()
assert len(names) > 150 and not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
from hazegrid.session import local_session
spark = local_session(cores=2, shuffle_partitions=2)
print("ROWS", e.entry(spark).count())
spark.stop()
"""


def test_entry_without_the_training_data_package(tmp_path):
    """With `hazegrid/llm` and its tests gone, with the pipeline's file left or gone too, everything else imports and runs."""
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    for left in (True, False):
        if not left:
            (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "repo", env=_env(), capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "ROWS" in done.stdout


def _env():
    import os

    return {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}

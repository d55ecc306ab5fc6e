"""The entry must work without the subpackage for training text."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
from khata.session import local_session
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries()), sorted(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
assert e.queries()["period_summary_this_month"](local_session(2), "/root/testdata/sf0.001").count() > 0
"""


def test_entry_without_training_text(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.md"))
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]

"""The library without its subpackage for training data: a copy of the repository lacks both folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_pipeline_module_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    say = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2:3].isdigit() for n in q), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", say], cwd=copy, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    n, pipeline, dealt, sql = got.stdout.split()
    assert int(n) > 100 and pipeline == "False" and dealt == "False" and int(sql) > 50

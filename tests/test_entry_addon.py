"""The training-data operators are an add-on: without their folders the rest still imports and registers its queries."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_add_on(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md", ".pytest_cache"))
    code = ("import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); "
            "assert 'r5_answer' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(o) <= set(q); print(len(q))")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr

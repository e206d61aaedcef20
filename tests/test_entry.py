"""The driver's contract, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(folder)}).stdout.split()


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "pricelens"), tmp_path / "pricelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    found = names(tmp_path)
    assert "market_estimate" in found and not any(n.startswith("op") and n[2].isdigit() for n in found)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "central" in out.columns

"""The entry module works without the llm subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(folder)})
    return out.stdout.split()


def test_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tripflow"), tmp_path / "tripflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    left = names(tmp_path)
    assert "slot_metrics_all" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

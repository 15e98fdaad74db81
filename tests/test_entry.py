"""The entry module works without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_the_corpus_folders(tmp_path):
    shutil.copytree(ROOT / "tarnwork", tmp_path / "tarnwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split("\n")
    assert "parameter_summary" in found[0].split() and not any(n.startswith("op") or n == "pipeline" for n in found[0].split())
    assert set(found[1].split()) <= set(found[0].split())

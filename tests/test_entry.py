"""The entry points without the folders of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_without_operators(tmp_path):
    """Without verdikt/llm, corpus_pipeline.py alone is left out and the other queries stay."""
    shutil.copytree(ROOT / "verdikt", tmp_path / "verdikt", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert "abac_decide" in said and "permitted_trades" in said
    assert "pipeline" not in said.split() and "op1_" not in said

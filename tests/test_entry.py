"""The entry module works without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest


@pytest.mark.parametrize("gone", ["faultline.llm", "corpus_pipeline"])
def test_without_a_module(gone):
    say = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    run = subprocess.run([sys.executable, "-c", say], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    assert "graph_edges" in run.stdout and "pipeline" not in run.stdout.split()
    assert ("op3_topk" in run.stdout) == (gone != "faultline.llm") or not (Path(__file__).parents[1] / "faultline/llm").is_dir()

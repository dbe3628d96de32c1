"""The entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; n = e.queries(); assert set(e.oracle_sql()) <= set(n); print(len(n), any(x.startswith('op') or x == 'pipeline' for x in n))"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_corpus_operators(tmp_path, with_pipeline):
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * (with_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"))):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/recollex", tmp_path / "recollex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, corpus = out.stdout.split() or (0, out.stderr)
    assert int(n) > 50 and corpus == "False", out.stderr

"""The entry works without the corpus operators, also where the pipeline file stays."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.join(os.path.dirname(__file__), "..")


def test_without_corpus_operators(folder):
    for name in ("strataflux", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, f"{folder}/{name}", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, folder)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert len(q) > 160 and not any(n.startswith('op1') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": folder})
    assert done.returncode == 0, done.stderr

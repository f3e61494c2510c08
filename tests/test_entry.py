"""The entry points without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(o) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; print('ok')"


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """With their folders deleted, with and without the pipeline's file."""
    bare = tmp_path / "repo"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for file in ("corpus_pipeline.py", None):
        done = subprocess.run([sys.executable, "-c", ASK], cwd=bare, capture_output=True, text=True, timeout=120)
        assert done.stdout.strip() == "ok", done.stderr
        if file:
            os.remove(bare / file) if (bare / file).exists() else None


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "quillstone")):
        if f"{os.sep}llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "quillstone.llm" not in f.read(), name

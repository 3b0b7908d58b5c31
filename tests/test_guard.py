"""The library without its training-data subpackage still imports and has its queries."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "packframe", tmp_path / "packframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, with_sql = map(int, said.stdout.split())
    assert n >= with_sql > 80


def test_the_other_tests_do_without_it(tmp_path):
    """In a copy without the folders and the pipeline all other tests are found, and some are run."""
    shutil.copytree(ROOT / "packframe", tmp_path / "packframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = lambda *how: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *how], cwd=tmp_path, capture_output=True, text=True)
    found = run("--collect-only", "tests")
    assert found.returncode == 0, found.stdout[-2000:]
    ran = run("tests/test_queries.py", "-k", "test_entry or doc_lengths or span_counts")
    assert ran.returncode == 0, ran.stdout[-2000:]


def test_a_broken_subpackage_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "packframe", tmp_path / "packframe", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if not (ROOT / name).exists():
            return
        shutil.copy(ROOT / name, tmp_path)
    if not (tmp_path / "packframe" / "llm").exists():
        return
    (tmp_path / "packframe" / "llm" / "common.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode != 0 and "no_such_module" in said.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "packframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "packframe.llm" not in path.read_text()

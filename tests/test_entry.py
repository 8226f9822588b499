"""The entry module without the optional text-preparation package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    run = subprocess.run(
        [sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True
    )
    names, with_sql = run.stdout.splitlines()[-2:]
    return set(names.split()), set(with_sql.split())


@pytest.mark.parametrize(
    "left_out",
    [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)],
)
def test_entry_without_the_optional_parts(tmp_path, left_out):
    ignored = shutil.ignore_patterns(*left_out, ".git", "__pycache__", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    names, with_sql = listed(tmp_path / "copy")
    assert len(names) > 60 and {"unify_counts", "tfidf_lr"} <= names
    assert not {n for n in names | with_sql if n.startswith("op") or n == "pipeline"}


def test_entry_without_a_library_that_only_the_optional_parts_need(tmp_path):
    ignored = shutil.ignore_patterns(".git", "__pycache__", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    (tmp_path / "copy" / "sentencepiece.py").write_text("raise ImportError('not installed')")
    names, _ = listed(tmp_path / "copy")
    assert "unify_counts" in names and "pipeline" not in names

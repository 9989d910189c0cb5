"""The entry module with and without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_works_without_the_training_data_folders(tmp_path):
    """A copy of the tree without the subpackage, its tests and the pipeline, or without the first two only."""
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.md")
    shutil.copytree(ROOT, tmp_path / "tree", ignore=left_out)
    script = "import __spark_entry__ as e; names = e.queries(); assert names and 'pipeline' not in names; assert not set(e.oracle_sql()) - set(names)"
    for module in ("corpus_pipeline.py", None):
        if module is not None:
            assert (tmp_path / "tree" / module).exists()
        done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "tree", capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        if module is not None:
            (tmp_path / "tree" / module).unlink()

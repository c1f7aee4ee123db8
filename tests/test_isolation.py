"""The library without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
keys = set(e.queries())
assert "punctuality" in keys and set(e.oracle_sql()) <= keys
assert not [k for k in keys if k == "pipeline" or (k[:2] == "op" and k[2:].split("_")[0].isdigit())], keys
import bench, check_queries
"""


@pytest.mark.parametrize("gone", [("wayfeed/llm", "tests/llm"), ("wayfeed/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_imports_without_the_text_operators(tmp_path, gone):
    left_out = {str(ROOT / g) for g in gone} | {str(ROOT / ".git")}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if f"{folder}/{n}" in left_out or n == "__pycache__"])
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")}, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "wayfeed").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            text = path.read_text()
            assert "wayfeed.llm" not in text and "from .llm" not in text and "from ..llm" not in text, path

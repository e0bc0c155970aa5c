"""The entry point with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [(), ("gridloom/llm",), ("corpus_pipeline.py", "gridloom/llm")])
def test_entry_imports(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "tests"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); print(all(n in q for n in e.oracle_sql()), 'range_query' in q, callable(e.entry))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert out.stdout.split()[-3:] == ["True", "True", "True"], out.stderr[-500:]


def test_nothing_else_imports_the_training_data_operators():
    for top, _, files in os.walk(os.path.join(REPO, "gridloom")):
        if os.path.basename(top) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(top, f)) as source:
                        assert "gridloom.llm" not in source.read(), f

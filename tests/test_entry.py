"""The library stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_subpackage(tmp_path):
    for name in ("spanloom", "__spark_entry__.py"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_imports_the_subpackage():
    for top, _, files in os.walk(os.path.join(REPO, "spanloom")):
        if f"{os.sep}llm" not in top:
            for f in files:
                if f.endswith(".py"):
                    assert "spanloom.llm" not in open(os.path.join(top, f), encoding="utf-8").read()

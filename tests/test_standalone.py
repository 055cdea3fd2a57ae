"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith(('op', 'pipeline')) for n in q), 'repertoire_diversity' in q)"


def test_entry_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, ops, there = said.stdout.split()
    assert int(n) > 80 and ops == "False" and there == "True"


def test_nothing_else_imports_the_subpackage():
    for top, dirs, files in os.walk(os.path.join(ROOT, "cloneloom")):
        if "llm" in dirs:
            dirs.remove("llm")
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(top, name)) as file:
                    assert "cloneloom.llm" not in file.read(), name

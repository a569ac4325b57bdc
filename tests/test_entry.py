from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(cwd, *args: str) -> None:
    """Runs Python in a folder whose modules come before those of the environment; what it said is shown where it fails."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(cwd), os.environ.get("PYTHONPATH")]))}
    done = subprocess.run([sys.executable, *args], cwd=cwd, env=env, capture_output=True, text=True)
    assert done.returncode == 0, f"{args}: exit {done.returncode}\n{done.stdout[-4000:]}\n{done.stderr[-4000:]}"


def test_without_llm(tmp_path):
    """The entry imports, and has the other queries, where the llm folder and the pipeline are gone."""
    shutil.copytree(f"{ROOT}/hopweave", tmp_path / "hopweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__", "test_entry.py"))
    run(tmp_path, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)")
    # the suite is collected there as well, and the quick modules run
    run(tmp_path, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    run(tmp_path, "-m", "pytest", "tests/test_text.py", "tests/test_sources.py", "-q", "-p", "no:cacheprovider")

"""The entry point with and without the subpackage for training data."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_training_data_folders(tmp_path):
    for name in ("tracequarry", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(HERE, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.isfile(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'launch_diff' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

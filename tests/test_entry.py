import os
import shutil
import subprocess
import sys
from pathlib import Path

from tessella import plans

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def counted(folder):
    env = os.environ | {"PYTHONPATH": str(folder)}
    said = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return tuple(map(int, said.stdout.split()))


def test_core_queries_load_without_the_training_data_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    core = len(plans.queries()), len(plans.oracle_sql())
    assert counted(tmp_path / "repo") == core
    (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    assert counted(tmp_path / "repo") == core

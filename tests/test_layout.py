"""The library without its training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    shutil.rmtree(copy / "loomtext/llm")
    shutil.rmtree(copy / "tests/llm")
    (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, timeout=120)
    run = [sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    subprocess.run([*run, "--collect-only", "tests"], cwd=copy, check=True, timeout=300, capture_output=True)
    subprocess.run([*run, "tests/test_text.py", "tests/test_bpe.py"], cwd=copy, check=True, timeout=900, capture_output=True)

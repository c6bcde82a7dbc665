"""The entry points without the corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_corpus_folders(tmp_path):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q) and 'pipeline' not in q and not [k for k in q if k.startswith('op1')]; print('ok')"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tree / name).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=tree, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": ""})
        assert done.stdout.strip() == "ok", done.stderr


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from orbispan.scratch import scratch_dir

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scratch_dir(Fake)

"""The library works where the optional subpackage and the pipeline were taken out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "catalens"), tmp_path / "catalens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 180 and not any(k.startswith('op') for k in q); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_a_missing_library_takes_only_its_queries(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 180 and not any(k.startswith('op') for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0 and "xxhash" in done.stderr, done.stderr


def test_other_tests_pass_without_the_optional_part(tmp_path):
    for name in ("catalens", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    some = ["tests/test_guard.py", "tests/test_entry.py", "tests/test_shared.py", "tests/test_queries.py::test_every_query_has_a_name_of_its_own", "tests/test_queries.py::test_flagship"]
    done = subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", *some], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stdout[-2000:]

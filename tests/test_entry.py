"""The entry module: what the driver calls, with and without the removable part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_of_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_it_works_without_the_removable_part(tmp_path):
    for name in ("__spark_entry__.py", "rastercat"):
        at = os.path.join(HERE, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "rastercat" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)

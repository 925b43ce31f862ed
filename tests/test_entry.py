import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

TOP = Path(__file__).resolve().parent.parent


def test_names_and_flagship(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "token", "score", "rank"] and df.count() > 0


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(TOP / "lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr[-2000:]
    n, names = said.stdout.split(" ", 1)
    assert int(n) > 90 and names.strip() == "[]"

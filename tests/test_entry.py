"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'flagship' in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["code", "vol", "ht"] and df.count() == 8


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data operators and their pipeline the entry still imports, and registers the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    shutil.copytree(top / "quantiva", tmp_path / "quantiva", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ask = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in q))"
    said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True, timeout=120)
    n, sql, ops = map(int, said.stdout.split())
    assert ops == 0 and n >= sql > 200

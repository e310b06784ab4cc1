"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from sparkloom import plans

HERE = Path(__file__).resolve().parent.parent


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert plans.FLAGSHIP in queries and set(plans.queries()) <= set(queries)
    assert set(oracle) <= set(queries)


def test_entry_runs(spark, sf):
    assert entry.entry(spark).count() == 4


def test_every_query_runs(spark, sf):
    for name, query in plans.queries().items():
        assert query(spark, sf).collect() is not None, name


def test_imports_without_the_corpus_operators(tmp_path):
    """With the subpackage and the pipeline gone, the rest works."""
    import shutil

    for part in ("__spark_entry__.py", "sparkloom"):
        source = HERE / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "sparkloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)

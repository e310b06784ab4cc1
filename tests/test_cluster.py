"""Queries on executors of their own, which share no memory with the driver."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent
RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
name, sf, shared = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
df = entry.queries()[name](spark, sf)
print("ROWS", json.dumps([df.columns, [list(r) for r in df.collect()]]))
spark.stop()
"""


def on_executors(name: str, sf: str, tmp_path: Path) -> tuple[list[str], list[list]]:
    import pyspark

    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    home.mkdir()
    (tmp_path / "shared").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYTHONPATH": str(HERE), "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    ran = subprocess.run([sys.executable, "-c", RUN, name, sf, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    found = [x for x in ran.stdout.splitlines() if x.startswith("ROWS ")]
    assert found, ran.stderr[-3000:]
    return json.loads(found[0].removeprefix("ROWS "))


@pytest.mark.parametrize("name", ["database_source", "jdbc_customers"])
def test_a_database_reaches_the_executors(sf, tmp_path, name):
    columns, got = on_executors(name, sf, tmp_path)
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)

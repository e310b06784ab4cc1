"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from sparkloom.shared import file_system, fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Tables written and not deleted yet, by path.
_held: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written once in the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _held[path] = spark
    return out


def _delete(path: str, spark: SparkSession) -> None:
    at, fs = file_system(spark, path)
    fs.delete(at, True)
    _held.pop(path, None)


def discard(*tables: DataFrame, collect: bool = True) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of finished jobs."""
    for df in tables:
        _delete(df.written_to, df.sparkSession)
    if not collect:
        return
    gc.collect()
    if spark := SparkSession.getActiveSession():
        spark.sparkContext._jvm.System.gc()


def held() -> set[str]:
    """The written tables there are: to be passed to release once what follows is consumed."""
    return set(_held)


def release(before: set[str], *keep: DataFrame) -> None:
    """Delete the tables written since ``before``, which a lazy result may have needed until now."""
    spared = before | {df.written_to for df in keep}
    for path, spark in [(p, s) for p, s in _held.items() if p not in spared]:
        _delete(path, spark)

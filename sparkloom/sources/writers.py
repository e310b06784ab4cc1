"""Writers: CSV without spreadsheet formulas, JSON, Parquet, INSERT text, PostgreSQL scripts, manifests.

Data is written by the executors, through Spark's commit protocol, into a staging
folder that is renamed when all is there.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.draws import ROW
from sparkloom.model import Dataset, SpecError
from sparkloom.operators.profile import q
from sparkloom.operators.rules import Rules
from sparkloom.shared import file_system

FORMULA = r"^[ \t\r\n]*[=+\-@]|^[\t\r\n]"
POSTGRES = {"bigint": "BIGINT", "int": "BIGINT", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


def safe_name(name: str) -> str:
    """A name that may become a file name."""
    if not _NAME.fullmatch(name):
        raise SpecError(f"{name!r} can't name a file")
    return name


def neutral(c: Column) -> Column:
    """Text that no spreadsheet runs: what starts like a formula gets a leading quote."""
    return F.when(c.rlike(FORMULA), F.concat(F.lit("'"), c)).otherwise(c)


def neutralised(df: DataFrame) -> DataFrame:
    name = lambda n: f"'{n}" if re.match(FORMULA, n) else n
    return df.select(*((neutral(q(f.name)) if f.dataType.simpleString() == "string" else q(f.name)).alias(name(f.name)) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    neutralised(df).write.options(header=True, escape='"', **keep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


# SQL text


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(df: DataFrame, name: str) -> Column:
    """A cell as a SQL literal; numbers that aren't finite have none."""
    kind, c = df.schema[name].dataType.simpleString(), q(name)
    if kind in ("double", "float"):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        text = F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: not finite: "), c.cast("string")))).otherwise(c.cast("string"))
    elif kind == "boolean":
        text = F.when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif kind in ("bigint", "int", "smallint", "tinyint") or kind.startswith("decimal"):
        text = c.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(text)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """value: an INSERT for each row."""
    columns = [c for c in df.columns if c != ROW]
    head = f"INSERT INTO {quoted(table)} ({', '.join(map(quoted, columns))}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *(literal(df, c) for c in columns)), F.lit(");")).alias("value"))


def create_table(df: DataFrame, table: str, primary_key: str | None = None) -> str:
    lines = [f"  {quoted(f.name)} {POSTGRES.get(f.dataType.simpleString(), 'TEXT')}" for f in df.schema if f.name != ROW]
    if primary_key:
        lines.append(f"  PRIMARY KEY ({quoted(primary_key)})")
    return f"CREATE TABLE {quoted(table)} (\n" + ",\n".join(lines) + "\n);"


def foreign_keys(spec: Dataset) -> list[str]:
    """Keys can only refer to primary keys; others are left out."""
    return [
        f"ALTER TABLE {quoted(r.child_entity)} ADD FOREIGN KEY ({quoted(r.child_field)}) REFERENCES {quoted(r.parent_entity)} ({quoted(r.parent_field)});"
        for r in spec.relationships
        if spec[r.parent_entity].primary_key == r.parent_field
    ]


def dependency_order(spec: Dataset) -> list[str]:
    """Parents before children; alphabetical where they form a circle."""
    names = sorted(e.name for e in spec.entities)
    needs = {n: {r.parent_entity for r in spec.relationships if r.child_entity == n} - {n} for n in names}
    out: list[str] = []
    while len(out) < len(names):
        ready = [n for n in names if n not in out and needs[n] <= set(out)]
        if not ready:
            return names
        out += ready
    return out


def postgres_script(spec: Dataset, tables: dict[str, DataFrame]) -> DataFrame:
    """value, in script order (part, row): DDL, rows in dependency order, keys, in one transaction."""
    spark = next(iter(tables.values())).sparkSession
    order = dependency_order(spec)
    text = lambda part, lines: spark.createDataFrame([(part, i, l) for i, l in enumerate(lines)], "part int, row bigint, value string")
    out = text(0, ["BEGIN;", *(create_table(tables[n], n, spec[n].primary_key) for n in order)])
    for i, n in enumerate(order, 1):
        df = tables[n]
        place = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
        rows = df.withColumn("__at", place)
        head = insert_statements(rows.drop("__at"), n)
        out = out.unionByName(rows.select(F.lit(i).alias("part"), F.col("__at").alias("row"), _insert(rows, n).alias("value"))) if head is not None else out
    out = out.unionByName(text(len(order) + 1, [*foreign_keys(spec), "COMMIT;"]))
    return out.orderBy("part", "row")


def _insert(df: DataFrame, table: str) -> Column:
    columns = [c for c in df.columns if c not in (ROW, "__at")]
    head = f"INSERT INTO {quoted(table)} ({', '.join(map(quoted, columns))}) VALUES ("
    return F.concat(F.lit(head), F.concat_ws(", ", *(literal(df, c) for c in columns)), F.lit(");"))


# bundles


#: Files from this size on are hashed as streams, one after the other.
LARGE = 1 << 30


def content_hashes(spark: SparkSession, folder: str, large: int = LARGE) -> DataFrame:
    """path (within the folder) and sha256 of every data file; files below ``large`` bytes are hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root, fs = file_system(spark, folder)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/")
    own = files.where(F.col("length") < large).select("path", F.sha2("content", 256).alias("sha256"))
    digest = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils
    streamed = []
    for r in files.where(F.col("length") >= large).select("path").collect():
        at, _ = file_system(spark, r["path"])
        stream = fs.open(at)
        try:
            streamed.append((r["path"], digest.sha256Hex(stream)))
        finally:
            stream.close()
    if streamed:
        own = own.unionByName(spark.createDataFrame(streamed, "path string, sha256 string"))
    name = F.regexp_extract("path", re.escape(base) + "/(.*)$", 1)
    skipped = "path NOT LIKE '%generation_manifest.json' AND path NOT LIKE '%\\_SUCCESS' AND path NOT LIKE '%.crc'"
    return own.select(name.alias("path"), "sha256").where(skipped)


def write_bundle(
    spark: SparkSession, spec: Dataset, tables: dict[str, DataFrame], folder: str, kind: str = "parquet", rules: Rules | None = None, report: dict[str, Any] | None = None,
    profile: Dataset | None = None,
) -> dict[str, Any]:
    """Tables, specification, profile, report and manifest, all or nothing; an existing folder is refused.

    Rows are counted while they are written.
    """
    writer = {"csv": write_csv, "json": write_json, "parquet": write_parquet}[kind]
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    at, fs = file_system(spark, folder)
    if fs.exists(at):
        raise SpecError(f"{folder} is there already")
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        writer(df.drop(ROW).observe(seen, F.count("*").alias("n")), f"{staging}/{safe_name(name)}.{kind}")
        counts[name] = seen.get["n"]
    import yaml

    put_text(spark, f"{staging}/dataset_spec.yaml", yaml.safe_dump(json.loads(json.dumps(spec.as_dict(), default=str)), sort_keys=True))
    if profile is not None:
        put_text(spark, f"{staging}/profile.json", json.dumps(profile.as_dict(), default=str, sort_keys=True, indent=1))
    put_text(spark, f"{staging}/validation_report.json", json.dumps(report or {}, default=str, sort_keys=True, indent=1))
    manifest = {
        "seed": spec.seed,
        "mode": spec.mode,
        "spec_sha256": spec.fingerprint(),
        "rules_sha256": rules.fingerprint() if rules else None,
        "row_counts": counts,
        "files": {r["path"]: r["sha256"] for r in content_hashes(spark, staging).orderBy("path").collect()},
    }
    put_text(spark, f"{staging}/generation_manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
    source, _ = file_system(spark, staging)
    if not fs.rename(source, at):
        raise SpecError(f"{folder} can't be published")
    return manifest


def put_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def verify_bundle(spark: SparkSession, folder: str) -> list[str]:
    """Paths whose content differs from the manifest, is missing or isn't listed."""
    text = "\n".join(r["value"] for r in spark.read.text(f"{folder}/generation_manifest.json").collect())
    want = json.loads(text)["files"]
    have = {r["path"]: r["sha256"] for r in content_hashes(spark, folder).collect()}
    return sorted(p for p in {*want, *have} if want.get(p) != have.get(p))


def write_document(path: str | Path, body: dict[str, Any]) -> str:
    """JSON or YAML by the name's ending, replaced at once; returns its sha256."""
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        import yaml

        text = yaml.safe_dump(body, sort_keys=True)
    else:
        text = json.dumps(body, sort_keys=True, indent=1, default=str)
    part = path.with_suffix(path.suffix + ".part")
    part.write_text(text)
    part.replace(path)
    return hashlib.sha256(text.encode()).hexdigest()

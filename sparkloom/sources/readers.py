"""Readers: CSV files and folders, dataset folders, Parquet metadata, specifications and profiles.

CSV is read as text in every column; types come from the profiler's parse guards, not
from Spark's inference, which accepts another language.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import json
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.functions import parse
from sparkloom.functions.draws import ROW
from sparkloom.model import Dataset, Entity, Field, SpecError, dataset_from_dict
from sparkloom.operators.rules import Rules, rules_from_dict
from sparkloom.shared import file_system

SAMPLE_BYTES, DELIMITERS = 8192, ",;\t|"
MOST_HEADER = 64 << 20
MOST_DEPTH, MOST_DOCUMENT = 50, 16 << 20


def _head(spark: SparkSession, path: str, n: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of a file of any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at, fs = file_system(spark, path)
    if fs.getFileStatus(at).isDirectory():  # as Spark writes tables
        parts = [p for p in _children(spark, path) if p.rsplit("/", 1)[-1].startswith("part-")]
        if not parts:
            raise SpecError(f"{path} holds no data")
        at = jvm.org.apache.hadoop.fs.Path(parts[0])
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def decoded(head: bytes) -> tuple[str, str]:
    """Encoding and text of a file's beginning; a character cut at its end is left out."""
    try:
        return "UTF-8", codecs.getincrementaldecoder("utf-8-sig")().decode(head)
    except UnicodeDecodeError:
        return "ISO-8859-1", head.decode("latin-1")


def sniff(head: bytes) -> dict[str, str]:
    """Encoding and delimiter of a CSV file's beginning."""
    encoding, text = decoded(head[:SAMPLE_BYTES])
    try:
        sep = csv.Sniffer().sniff(text, DELIMITERS).delimiter
    except csv.Error:
        sep = ","
    return {"encoding": encoding, "sep": sep}


def record_end(text: str, sep: str) -> int:
    """Where the first record ends, or -1 if the text ends before it does."""
    quoted, opens, at = False, True, 0
    while at < len(text):
        c = text[at]
        if quoted:
            if c == '"':
                if text[at + 1 : at + 2] == '"':
                    at += 1
                else:
                    quoted = False
        elif c in "\r\n":
            return at
        elif c == '"' and opens:
            quoted = True
        opens = not quoted and c == sep
        at += 1
    return -1


def csv_header(spark: SparkSession, path: str) -> tuple[list[str], dict[str, str]]:
    """Checked column names and the dialect of a CSV file; the header is read to its end, however long."""
    n = SAMPLE_BYTES
    head = _head(spark, path, n)
    found = sniff(head)
    while True:
        text = decoded(head)[1] if found["encoding"] == "UTF-8" else head.decode("latin-1")
        end = record_end(text, found["sep"])
        if end >= 0 or len(head) < n:
            break
        if n >= MOST_HEADER:
            raise SpecError(f"{path}: the header doesn't end within {MOST_HEADER} bytes")
        n *= 8
        head = _head(spark, path, n)
    record = text if end < 0 else text[:end]
    return check_header(next(csv.reader(io.StringIO(record, newline=""), delimiter=found["sep"]), [])), found


def check_header(names: list[str]) -> list[str]:
    names = [n.strip().lstrip("﻿") for n in names]
    if not names or any(not n for n in names):
        raise SpecError("a CSV header must name every column")
    if len(set(names)) != len(names):
        raise SpecError("a CSV header must name each column once")
    return names


def breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether a cell may hold a line break: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def csv_file(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV file with a header; every column is text.

    A file whose cells hold line breaks can't be split, so one task reads it; whether any
    does is looked up in a pass of its own (which ends at the first), unless the caller
    says so in multi_line.
    """
    names, found = csv_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    whole = breaks_lines(spark, path) if multi_line is None else multi_line
    options = {"header": True, "sep": found["sep"], "encoding": found["encoding"], "quote": '"', "escape": '"', "multiLine": whole, "enforceSchema": True}
    return spark.read.schema(schema).options(**options, maxColumns=max(20480, len(names) + 1)).csv(path)


def _children(spark: SparkSession, folder: str) -> list[str]:
    at, fs = file_system(spark, folder)
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(at))


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def csv_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One table for each ``*.csv``, by file name."""
    return {stem(p): csv_file(spark, p) for p in _children(spark, folder) if p.lower().endswith(".csv")}


def dataset_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables from .csv, .json (an array, or a line each) and .parquet files; two files of one name are refused."""
    out: dict[str, DataFrame] = {}
    for p in _children(spark, folder):
        kind = p.rstrip("/").rsplit(".", 1)[-1].lower()
        if kind not in ("csv", "json", "parquet") or p.endswith(("/profile.json", "/validation_report.json", "manifest.json")):
            continue
        if stem(p) in out:
            raise SpecError(f"two files hold {stem(p)}")
        if kind == "csv":
            out[stem(p)] = csv_file(spark, p)
        elif kind == "parquet":
            out[stem(p)] = spark.read.parquet(p)
        else:
            array = _head(spark, p, 64).lstrip()[:1] == b"["
            out[stem(p)] = spark.read.option("multiLine", array).json(p)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """df with ROW: the place of each row, from 0.

    Rows of files count by file name, then place in the file; others by partition.  Counts
    are taken for each block of a file (or partition) and added up over those alone.
    """
    try:
        held = df.withColumns({"__part": F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))})
    except AnalysisException:
        held = df.withColumn("__part", F.struct(F.lit("").alias("file"), F.spark_partition_id().cast("bigint").alias("at")))
    held = held.withColumn("__mono", F.monotonically_increasing_id())
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__mono").alias("__first"))
    offset = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(offset), F.lit(0))).select("__part", "__first", "__base")
    return held.join(base, "__part").withColumn(ROW, F.col("__mono") - F.col("__first") + F.col("__base")).drop("__part", "__mono", "__first", "__base")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by place, not a random sample."""
    return df.where(F.col(ROW) < n)


def parquet_metadata(spark: SparkSession, path: str) -> Entity:
    """Schema and row count alone: no value is read."""
    df = spark.read.parquet(path)
    fields = [Field(f.name, parse.logical_type(f.dataType), f.nullable) for f in df.schema]
    return Entity(stem(path), df.count(), fields)


# documents


def bounded(text: str) -> str:
    if len(text) > MOST_DOCUMENT:
        raise SpecError("document is too large")
    return text


def _depth(value: Any, level: int = 0) -> None:
    if level > MOST_DEPTH:
        raise SpecError("document is nested too deep")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _depth(v, level + 1)


def load_document(path: str | Path) -> Any:
    """JSON or YAML (no aliases) of bounded size and depth."""
    text = bounded(Path(path).read_text("utf-8"))
    if str(path).endswith(".json"):
        out = json.loads(text)
    else:
        import yaml

        if any(isinstance(t, yaml.AliasToken) for t in yaml.scan(text)):
            raise SpecError("aliases are not allowed")
        out = yaml.safe_load(text)
    _depth(out)
    return out


def load_spec(path: str | Path) -> Dataset:
    body = load_document(path)
    if not isinstance(body, dict) or any(k in body for k in ("columns", "source_type", "profile_version")):
        raise SpecError("this is a profile, not a specification")
    return dataset_from_dict(body)


def load_rules(path: str | Path) -> Rules:
    return rules_from_dict(load_document(path) or {})


def load_profile(path: str | Path) -> Dataset:
    """A profile of either shape: entities with fields, or one flat list of columns."""
    return profile_from_dict(load_document(path))


#: fixed values: database type names by the part that decides, in order
_NAMED = (("bool", "boolean"), ("timestamp", "datetime"), ("date", "date"), ("int", "integer"), ("serial", "integer"))
_NUMBERS = ("double", "real", "float", "decimal", "numeric")
_TEXTUAL = ("email", "phone", "name", "address", "uuid")


def logical_name(name: str) -> tuple[str, str | None]:
    """Logical and semantic type of a database or profile type name; intervals and nested types are refused."""
    n = name.lower()
    if n.startswith(("interval", "array", "map", "row", "struct")):
        raise TypeError(f"column type {name} is not scalar")
    if n in _TEXTUAL:
        return "string", n
    if any(p in n for p in _NUMBERS):
        return "float", None
    return next((kind for part, kind in _NAMED if part in n), "string"), None


def profile_from_dict(body: dict[str, Any]) -> Dataset:
    if "entities" in body:
        return dataset_from_dict(body, spec=False)
    from sparkloom.functions import privacy
    from sparkloom.operators.profile import identifier_name

    fields, total = [], int(body.get("row_count") or 0)
    for c in body.get("columns", []):
        kind, semantic = logical_name(str(c.get("data_type") or c.get("type") or "string"))
        semantic = c.get("semantic_type") or semantic
        f = Field(c["name"], kind, bool(c.get("null_ratio")), float(c.get("null_ratio") or 0), semantic_type=semantic, is_identifier=identifier_name(c["name"]))
        if c.get("distinct_count") and total:
            f.unique_ratio = round(min(1.0, c["distinct_count"] / total), 6)
        f.sensitive = bool(c.get("sensitive")) or privacy.sensitive_field(f.name, semantic)
        top = c.get("top_values") or []
        if f.is_identifier:
            f.distribution = {"kind": "synthetic_identifier", "prefix": str(body.get("table") or body.get("name") or "row")}
        elif f.sensitive and kind == "string":
            f.distribution = {"kind": "masked_patterns", "patterns": [{"pattern": semantic or "text", "count": total}]}
        elif kind in ("integer", "float") and any(c.get(k) is not None for k in ("min", "max", "p05", "p95")):
            f.distribution = {"kind": "numeric", **{k: c.get(k) for k in ("min", "max", "p05", "p95")}}
        elif kind in ("date", "datetime") and c.get("min"):
            f.distribution = {"kind": f"{kind}_range", "min": c.get("min"), "max": c.get("max")}
        elif top:
            f.distribution = {"kind": "categorical", "values": privacy.rank_labels([t["count"] for t in top], [str(t["value"]) for t in top])}
        fields.append(f)
    name = str(body.get("table") or body.get("name") or "dataset")
    keys = [f.name for f in fields if f.is_identifier and f.unique_ratio >= 1.0]
    return Dataset([Entity(name, total, fields, None, keys)], name=name)


# databases and catalogs


def jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None, partition: dict[str, Any] | None = None) -> DataFrame:
    """A query of a database through JDBC; the driver's jar is the caller's.  partition: column, low, high, n."""
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if partition:
        return reader.options(dbtable=f"({query}) q", partitionColumn=partition["column"], lowerBound=partition["low"], upperBound=partition["high"], numPartitions=partition["n"]).load()
    return reader.option("query", query).load()


def catalog(spark: SparkSession, allowed: set[str] | None = None) -> list[dict[str, str]]:
    """Tables of the current database and their columns, within an allowlist of ``table`` or ``table.column``."""
    out = []
    for t in spark.catalog.listTables():
        for c in spark.catalog.listColumns(t.name):
            if allowed is None or t.name in allowed or f"{t.name}.*" in allowed or f"{t.name}.{c.name}" in allowed:
                out.append({"table": t.name, "column": c.name, "type": c.dataType})
    return sorted(out, key=lambda r: (r["table"], r["column"]))


def folder_fingerprint(spark: SparkSession, folder: str, *settings: Any) -> str:
    """Key of a profile cache: names, sizes and times of the files, and every setting that shapes the profile."""
    at, fs = file_system(spark, folder)
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))
    return hashlib.sha256(json.dumps([files, settings], default=str, sort_keys=True).encode()).hexdigest()


def cached_profile(cache: str | Path, key: str, make) -> Dataset:
    """A profile from the cache folder, or made and put there."""
    at = Path(cache) / f"{key}.json"
    if at.exists():
        return dataset_from_dict(json.loads(at.read_text()), spec=False)
    out = make()
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(out.as_dict(), default=str, sort_keys=True))
    return out

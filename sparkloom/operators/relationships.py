"""Foreign keys: coverage, discovery by containment, and metadata candidates."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.model import Dataset, Field, Relationship
from sparkloom.operators.profile import identifier_name, q

CONTAINED = 0.8


def coverage(child: DataFrame, child_field: str, parent: DataFrame, parent_field: str) -> DataFrame:
    """child_rows, checked, matched, orphans; null children aren't checked."""
    keys = parent.select(q(parent_field).alias("__key")).where("__key IS NOT NULL").distinct()
    rows = child.select(q(child_field).alias("__child")).groupBy("__child").agg(F.count("*").alias("__n"))  # one row for each key before the join
    joined = rows.join(keys, F.col("__child") == F.col("__key"), "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0))
    have, met = F.col("__child").isNotNull(), F.col("__key").isNotNull()
    return joined.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("child_rows"), n(have).alias("checked"), n(have & met).alias("matched"), n(have & ~met).alias("orphans")
    )


def orphans(child: DataFrame, child_field: str, parent: DataFrame, parent_field: str, null_safe: bool = False) -> DataFrame:
    """Child rows without a parent.  Null keys are orphans, unless null_safe and a parent key is null."""
    keys = parent.select(q(parent_field).alias("__key")).distinct()
    c = child[child_field] if "." not in child_field else q(child_field)
    return child.join(keys, c.eqNullSafe(F.col("__key")) if null_safe else c == F.col("__key"), "left_anti")


def _cells(tables: dict[str, DataFrame], fields: dict[str, list[str]]) -> DataFrame:
    """entity, field, value, n over all identifier columns, counted before anything is joined."""
    parts = []
    for name, df in tables.items():
        if not fields[name]:
            continue
        rows = F.array(*(F.struct(F.lit(f).alias("field"), q(f).cast("string").alias("value")) for f in fields[name]))
        parts.append(df.select(F.inline(rows)).where("value IS NOT NULL AND value <> ''").groupBy(F.lit(name).alias("entity"), "field", "value").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def discover(tables: dict[str, DataFrame], contained: float = CONTAINED, is_key=identifier_name) -> DataFrame:
    """child, child_field, parent, parent_field, confidence, best: identifier columns whose values lie in another's.

    All pairs at once: columns are unpivoted and counted, then joined on the value.
    A child column keeps its most confident parent (ties: by table order).
    """
    order = {name: i for i, name in enumerate(tables)}
    fields = {n: [f for f in df.columns if is_key(f)] for n, df in tables.items()}
    if not any(fields.values()):
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "child string, child_field string, parent string, parent_field string, confidence double, best boolean")
    cells = _cells(tables, fields)
    total = cells.groupBy("entity", "field").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    parents = cells.join(total, ["entity", "field"]).where("most = 1").select(F.col("entity").alias("parent"), F.col("field").alias("parent_field"), "value")
    pairs = (
        cells.join(parents, "value")
        .where("entity <> parent")
        .groupBy(F.col("entity").alias("child"), F.col("field").alias("child_field"), "parent", "parent_field")
        .agg(F.sum("n").alias("met"))
    )
    sized = pairs.join(total.select(F.col("entity").alias("child"), F.col("field").alias("child_field"), "total"), ["child", "child_field"])
    scored = sized.withColumn("confidence", F.round(F.col("met") / F.col("total"), 6)).where(F.col("confidence") >= contained)
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    best = scored.groupBy("child", "child_field").agg(
        F.max_by(F.struct("parent", "parent_field"), F.struct("confidence", -rank[F.col("parent")], F.col("parent_field"))).alias("b")
    )
    return scored.join(best, ["child", "child_field"]).select(
        "child", "child_field", "parent", "parent_field", "confidence", (F.struct("parent", "parent_field") == F.col("b")).alias("best")
    )


def relationships(tables: dict[str, DataFrame], **kw) -> list[Relationship]:
    found = discover(tables, **kw).where("best").collect()
    return [Relationship(r["parent"], r["parent_field"], r["child"], r["child_field"], confidence=r["confidence"]) for r in sorted(found)]


# candidates from metadata alone

#: fixed values: name parts of the two ends of a span of time
START_PARTS = {"start", "started", "from", "begin", "created"}
END_PARTS = {"end", "ended", "to", "finish", "closed", "updated"}


def candidates(profile: Dataset) -> list[dict]:
    """Value-free foreign-key and time-order hypotheses, each with an id of its content.

    Keys are indexed by field name and times by their role, so each field is looked at
    once.  Ids are hashes of our own evidence record; another program's differ.
    """
    keys: dict[str, list] = {}
    for e in profile.entities:
        for name in e.primary_key_candidates:
            keys.setdefault(name, []).append((e, e[name]))
    found = [_key_candidate(parent, p, child, f) for child in profile.entities for f in child.fields for parent, p in keys.get(f.name, ()) if parent.name != child.name and _compatible(p, f)]
    for e in profile.entities:
        roles = {f.name: (_role(f, START_PARTS), _role(f, END_PARTS)) for f in e.fields}
        starts = [f for f in e.fields if roles[f.name][0]]
        ends = [f for f in e.fields if roles[f.name] == (False, True)]
        spans = ((a, b, _overlap(a, b)) for a in starts for b in ends if a.data_type == b.data_type)
        found += [_candidate("temporal", [(e.name, a.name), (e.name, b.name)], {"type_compatibility": 1.0, "range_overlap": o}, (1 + o) / 2) for a, b, o in spans if o is not None]
    return sorted(found, key=lambda c: c["candidate_id"])


def _key_candidate(parent, p: Field, child, f: Field) -> dict:
    sizes = sorted((parent.row_count, child.row_count))
    evidence = {
        "type_compatibility": 1.0, "parent_unique_ratio": p.unique_ratio, "child_null_ratio": f.null_ratio,
        "child_distinct_ratio": f.unique_ratio, "cardinality_ratio": round(sizes[0] / max(sizes[1], 1), 6),
    }
    return _candidate("foreign_key", [(parent.name, p.name), (child.name, f.name)], evidence, (2 + p.unique_ratio - f.null_ratio) / 3)


def _candidate(kind: str, at: list[tuple[str, str]], evidence: dict[str, float], score: float) -> dict:
    body = {"kind": kind, "fields": [{"entity": e, "field": f} for e, f in at], "evidence": evidence}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return body | {"candidate_id": digest, "confidence": round(score, 6)}


def _compatible(a: Field, b: Field) -> bool:
    return a.data_type == b.data_type or {a.data_type, b.data_type} <= {"integer", "float"}


def _role(f: Field, parts: set[str]) -> bool:
    return f.data_type in ("date", "datetime") and bool(parts & set(f.name.lower().replace("-", "_").split("_")))


def _overlap(a: Field, b: Field) -> float | None:
    x, y = a.distribution or {}, b.distribution or {}
    if any(d.get(k) is None for d in (x, y) for k in ("min", "max")):
        return None
    if x["max"] <= y["min"]:
        return 1.0
    return 0.0 if x["min"] > y["max"] else 0.5


def ranked(proposals: list[dict], advisor=None) -> list[dict]:
    """Candidates in an advisor's order; an advisor can't add, drop or change any."""
    if advisor is None:
        return sorted(proposals, key=lambda c: (-c["confidence"], c["candidate_id"]))
    known = {c["candidate_id"]: c for c in proposals}
    order = list(advisor([dict(c) for c in proposals]))
    if sorted(order) != sorted(known):
        raise ValueError("an advisor must return the ids it was given, each once")
    return [known[i] for i in order]

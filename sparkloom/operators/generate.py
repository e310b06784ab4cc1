"""Rows from a specification.

Each value is a function of (seed, entity, field, row) alone: ``spark.range`` and
built-in expressions, no shuffle, the same rows whatever the partitions.  Keys between
entities are assigned by position; derived columns are solved in a fixed order:
relationships, formulas, time orders, conditional requirements, aggregates.

Mixed and negative modes put invalid values into fields that aren't identifiers.  A
DataFrame column has one type, so there all columns come as text, and ``__invalid``
names the fields of a row that were spoiled.
"""

from __future__ import annotations

import math
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import draws, formula, parse
from sparkloom.functions.draws import ROW
from sparkloom.model import Dataset, Entity, Field, SpecError, check_spec
from sparkloom.operators.profile import q
from sparkloom.operators.rule_profiles import aggregated

INVALID = "__invalid"
#: fixed values: defaults of each type and of two semantic types, the wrong value of each type, and the default span of time
DEFAULTS = {"integer": 0, "float": 0.0, "boolean": False, "string": "required", "date": "2000-01-01", "datetime": "2000-01-01T00:00:00"}
SEMANTIC_DEFAULTS = {"email": "synthetic@example.test", "phone": "+1-202-555-0100"}
WRONG = {"integer": "not-a-number", "float": "not-a-number", "boolean": "not-a-boolean", "date": "not-a-timestamp", "datetime": "not-a-timestamp", "string": "12345"}
FIRST, LAST = 1577836800, 1735689600


def plan(profile: Dataset, row_count: int | None = None, seed: int = 0, mode: str = "valid") -> Dataset:
    """A specification from a profile."""
    entities = []
    for e in profile.entities:
        key = e.primary_key or next(iter(e.primary_key_candidates), None)
        entities.append(Entity(e.name, row_count or max(e.row_count, 1), e.fields, key, e.primary_key_candidates))
    return check_spec(Dataset(entities, profile.relationships, profile.constraints, profile.name, seed=seed, mode=mode))


def identifier(seed: int, entity: str, f: Field) -> Column:
    if f.data_type in ("integer", "float"):
        return (F.lit(seed * 1_000_000 + 1).cast("bigint") + F.col(ROW)).cast(parse.SPARK_TYPE[f.data_type])
    return F.format_string(f"syn_{entity}_%08d", F.col(ROW) + 1)


def sensitive_text(seed: int, entity: str, f: Field, fast: bool) -> Column:
    key = F.concat(F.lit(f"{seed}|{entity}|{f.name}|text|"), F.col(ROW).cast("string"))
    token = F.lower(F.lpad(F.hex(F.xxhash64(key)), 16, "0")) if fast else F.md5(key)
    u = draws.uniform(seed, entity, f.name, "digits", fast=fast)
    kind, name = (f.semantic_type or "").lower(), f.name.lower()
    if kind == "email" or "mail" in name:
        return F.concat(F.lit("user_"), F.substring(token, 1, 12), F.lit("@example.test"))
    if kind == "phone" or "phone" in name:
        return F.concat(F.lit("+1-202-555-01"), F.lpad(draws.whole(u, 0, 99).cast("string"), 2, "0"))
    if kind == "ssn" or "ssn" in name:
        return F.concat(F.lit("000-00-"), F.lpad(draws.whole(u, 0, 9999).cast("string"), 4, "0"))
    return F.concat(F.lit("synthetic_"), F.substring(token, 1, 12))


def _numeric_bounds(d: dict) -> tuple[float, float]:
    if d.get("kind") == "numeric_shape":
        m = d.get("max_abs_magnitude")
        top = 9.0 * 10.0**m if m is not None else 0.0
        return (-top if d.get("has_negative") else 0.0, top if d.get("has_positive") else 0.0)
    if d.get("kind") != "numeric":
        return 0.0, 1000.0
    low = next((d[k] for k in ("p05", "min") if d.get(k) is not None), 0)
    high = next((d[k] for k in ("p95", "max") if d.get(k) is not None), 1000)
    scale = d.get("scale_factor", 1.0)
    return float(low) * scale, float(max(low, high)) * scale


def default_value(f: Field):
    """What a field gets where a constraint requires it: the first thing its distribution allows, else its type's default."""
    d = f.distribution or {}
    if d.get("kind") == "categorical" and d["values"]:
        return d["values"][0]["value"]
    if d.get("kind") == "numeric":
        return next((d[k] for k in ("min", "p05", "max", "p95") if d.get(k) is not None), 0)
    if d.get("kind") in ("date_range", "datetime_range") and d.get("min"):
        return str(d["min"])
    if f.data_type == "string" and f.semantic_type in SEMANTIC_DEFAULTS:
        return SEMANTIC_DEFAULTS[f.semantic_type]
    return DEFAULTS[f.data_type]


def _seconds(value, default: int) -> int:
    from datetime import UTC, datetime

    if value is None:
        return default
    at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def field_value(spec_seed: int, entity: str, f: Field, fast: bool = False) -> Column:
    """A valid value of a field, nulls included."""
    if f.is_identifier:
        return identifier(spec_seed, entity, f)
    u = draws.uniform(spec_seed, entity, f.name, "value", fast=fast)
    d, kind = f.distribution or {}, f.data_type
    if kind == "string":
        if f.sensitive:
            value = sensitive_text(spec_seed, entity, f, fast)
        elif d.get("kind") == "categorical":
            value = draws.weighted(u, [str(v["value"]) for v in d["values"]], [v["weight"] for v in d["values"]])
        else:
            low, high = (d.get("min_length", 6), d.get("max_length", 12)) if d.get("kind") == "string_pattern" else (6, 12)
            value = F.concat(F.lit("syn_"), draws.letters(spec_seed, entity, f.name, draws.whole(u, max(1, low), max(1, high)), fast))
    elif kind == "boolean":
        value = u < F.lit(float(d.get("true_ratio", 0.5)))
    elif kind in ("date", "datetime"):
        low, high = (_seconds(d.get(k), x) for k, x in (("min", FIRST), ("max", LAST)))
        value = F.timestamp_seconds(draws.whole(u, low, max(low, high)))
        value = value.cast("date") if kind == "date" else value
    elif d.get("kind") == "categorical":
        value = draws.weighted(u, [v["value"] for v in d["values"]], [v["weight"] for v in d["values"]]).cast(parse.SPARK_TYPE[kind])
    else:
        low, high = _numeric_bounds(d)
        x = F.lit(low) + u * F.lit(high - low)
        if kind == "integer":
            a, b = math.ceil(low), math.floor(high)
            value = F.greatest(F.lit(a), F.least(F.lit(b), F.bround(x, 0))).cast("bigint") if a <= b else F.bround(x, 0).cast("bigint")
        else:
            value = F.bround(x, 6)
    if f.nullable and f.null_ratio > 0:
        value = F.when(draws.uniform(spec_seed, entity, f.name, "null", fast=fast) < f.null_ratio, F.lit(None)).otherwise(value)
    return value.cast(parse.SPARK_TYPE[kind])


def rows(spark: SparkSession, spec: Dataset, entity: Entity, fast: bool = False, providers: dict | None = None) -> DataFrame:
    """An entity's own columns, before anything is solved; providers[(entity, field)] may give a Column of ROW."""
    seed = spec.seed + [e.name for e in spec.entities].index(entity.name)
    base = spark.range(entity.row_count).withColumnRenamed("id", ROW)
    columns = []
    for f in entity.fields:
        custom = (providers or {}).get((entity.name, f.name))
        c = custom(F.col(ROW)) if custom else field_value(seed, entity.name, f, fast)
        if custom and f.data_type == "string":
            c = F.when(c.startswith("synthetic_"), c).otherwise(F.concat(F.lit("synthetic_"), c))
        columns.append(c.cast(parse.SPARK_TYPE[f.data_type]).alias(f.name))
    return base.select(ROW, *columns)


def assign_keys(child: DataFrame, child_field: str, parent: DataFrame, parent_field: str, n_parents: int, one_to_one: bool = False) -> DataFrame:
    """Child row i gets the key of parent row i (modulo the parents, unless one_to_one)."""
    keys = parent.select(F.col(ROW).alias("__at"), q(parent_field).alias("__key"))
    at = F.col(ROW) if one_to_one else F.pmod(F.col(ROW), F.lit(n_parents))
    joined = child.withColumn("__want", at).join(keys, F.col("__want") == F.col("__at"), "left")
    return joined.select(*(F.col("__key").cast(child.schema[c].dataType).alias(c) if c == child_field else q(c) for c in child.columns))


def solve(spec: Dataset, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fill what relationships and constraints determine, in their fixed order, once."""
    out = dict(tables)
    for r in spec.relationships:
        n = spec[r.parent_entity].row_count
        if r.kind == "one_to_one" and spec[r.child_entity].row_count > n:
            raise SpecError(f"{r.child_entity} has more rows than {r.parent_entity} in a one-to-one relationship")
        f = spec[r.parent_entity][r.parent_field]
        parent = out[r.parent_entity]
        if f.is_identifier and not any(o.child_entity == r.parent_entity and o.child_field == r.parent_field for o in spec.relationships):
            # an identifier is a function of the row, so no join is needed to look it up
            seed = spec.seed + [e.name for e in spec.entities].index(r.parent_entity)
            at = F.col(ROW) if r.kind == "one_to_one" else F.pmod(F.col(ROW), F.lit(n))
            child = out[r.child_entity].withColumn("__own", F.col(ROW)).withColumn(ROW, at)
            kind = child.schema[r.child_field].dataType
            child = child.withColumn(r.child_field, identifier(seed, r.parent_entity, f).cast(kind))
            out[r.child_entity] = child.withColumn(ROW, F.col("__own")).drop("__own")
        else:
            out[r.child_entity] = assign_keys(out[r.child_entity], r.child_field, parent, r.parent_field, n, r.kind == "one_to_one")
    by = lambda kind: [c for c in spec.constraints if c.kind == kind]
    for c in by("formula"):
        kind = spec[c.entity][c.target].data_type
        value = formula.parse(c.expression).column()
        value = F.bround(value, 0).cast("bigint") if kind == "integer" else F.bround(value, 6)
        out[c.entity] = out[c.entity].withColumn(c.target, F.coalesce(value, q(c.target)).cast(parse.SPARK_TYPE[kind]))
    for c in by("temporal"):
        s, e = q(c.start), q(c.end)
        out[c.entity] = out[c.entity].withColumn(c.end, F.when(s.isNotNull() & (e.isNull() | (e < s)), s.cast(out[c.entity].schema[c.end].dataType)).otherwise(e))
    for c in by("conditional_required"):
        f = spec[c.entity][c.required_field]
        cond, x = q(c.condition_field), q(c.required_field)
        missing = x.isNull() | (x.cast("string") == "")
        fill = F.lit(default_value(f)).cast(parse.SPARK_TYPE[f.data_type])
        out[c.entity] = out[c.entity].withColumn(c.required_field, F.when(F.coalesce(cond == F.lit(c.condition_value), F.lit(False)) & missing, fill).otherwise(x))
    for c in by("aggregate_mapping"):
        r = next((r for r in spec.relationships if (r.parent_entity, r.child_entity) == (c.entity, c.child_entity)), None)
        if r is None:
            continue
        held = aggregated(out[c.child_entity], r.child_field, c.child_field, c.aggregate or "sum")
        kind = spec[c.entity][c.target].data_type
        parent = out[c.entity]
        value = F.bround(F.coalesce("__value", F.lit(0.0)), 6)
        value = F.bround(value, 0).cast("bigint") if kind == "integer" else value
        joined = parent.join(held, q(r.parent_field) == F.col("__key"), "left").withColumn(c.target, value.cast(parse.SPARK_TYPE[kind]))
        out[c.entity] = joined.select(*(q(n) for n in parent.columns))
    return out


def spoil(spec: Dataset, tables: dict[str, DataFrame], fast: bool = False) -> dict[str, DataFrame]:
    """Invalid values: in negative mode in every field but identifiers, in mixed mode by invalid_ratio."""
    out = {}
    for i, e in enumerate(spec.entities):
        df, columns, marks = tables[e.name], [], []
        for f in e.fields:
            text = q(f.name).cast("string")
            if f.is_identifier:
                columns.append(text.alias(f.name))
                continue
            hit = F.lit(True) if spec.mode == "negative" else draws.uniform(spec.seed + i, e.name, f.name, "invalid", fast=fast) < spec.invalid_ratio
            columns.append(F.when(hit, F.lit(WRONG[f.data_type])).otherwise(text).alias(f.name))
            marks.append(F.when(hit, F.lit(f.name)))
        flags = F.filter(F.array(*marks), lambda x: x.isNotNull()) if marks else F.array().cast("array<string>")
        out[e.name] = df.select(ROW, *columns, flags.alias(INVALID))
    return out


def generate(spark: SparkSession, spec: Dataset, fast: bool = False, providers: dict | None = None, keep_row: bool = False, provider_seconds: float = 60.0) -> dict[str, DataFrame]:
    """All entities of a specification.  Providers must give the same values twice, within provider_seconds."""
    check_spec(spec)
    for (entity, name), provider in (providers or {}).items():
        check_provider(spark, spec, entity, name, provider, provider_seconds)
    out = solve(spec, {e.name: rows(spark, spec, e, fast, providers) for e in spec.entities})
    if spec.mode in ("mixed", "negative"):
        out = spoil(spec, out, fast)
    return out if keep_row else {n: df.drop(ROW) for n, df in out.items()}


def check_provider(spark: SparkSession, spec: Dataset, entity: str, name: str, provider, seconds: float) -> None:
    """Refuses a provider that isn't reproducible, or takes longer; its jobs are cancelled then."""
    group, late = f"provider-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, f"replay of {entity}.{name}", True)
    timer.start()
    try:
        differ = replayed(spec, entity, name, provider, spark)
    except Exception as e:
        if late.is_set():
            raise SpecError(f"{entity}.{name}: the provider takes more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if differ:
        raise SpecError(f"{entity}.{name}: the provider isn't reproducible")


def replayed(spec: Dataset, entity: str, field: str, provider, spark: SparkSession) -> int:
    """How many rows of a provider differ between two evaluations: 0 if it is reproducible."""
    base = spark.range(spec[entity].row_count).withColumnRenamed("id", ROW)
    twice = base.select(provider(F.col(ROW)).alias("a")).select("a"), base.select(provider(F.col(ROW)).alias("b")).select("b")
    one, two = (t.agg(F.sum(F.xxhash64(t.columns[0]).cast("decimal(20,0)"))).first()[0] for t in twice)
    return 0 if one == two else base.select((~provider(F.col(ROW)).eqNullSafe(provider(F.col(ROW)))).cast("int").alias("d")).agg(F.sum("d")).first()[0] or 1

"""Checks of generated tables against a specification, and of output against its source."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import formula, parse, privacy
from sparkloom.functions.draws import ROW
from sparkloom.model import Dataset, SpecError
from sparkloom.operators.generate import INVALID
from sparkloom.operators.profile import q
from sparkloom.operators.relationships import orphans
from sparkloom.operators.rule_profiles import aggregated
from sparkloom.operators.rules import blank
from sparkloom.shared import file_system


def schema_errors(spec: Dataset, tables: dict[str, DataFrame]) -> DataFrame | None:
    """entity, field, check, n: rows beyond what the specification allows, one scan a table."""
    parts = []
    for e in spec.entities:
        if e.name not in tables:
            continue
        df = tables[e.name]
        have = [f for f in e.fields if f.name in df.columns]
        tests = [("", "row_count", F.abs(F.count("*") - e.row_count))]
        for f in have:
            c = q(f.name)
            if not f.nullable:
                tests.append((f.name, "required", F.count_if(blank(c))))
            if f.data_type in parse.PARSERS and df.schema[f.name].dataType.simpleString() == "string":
                tests.append((f.name, "type", F.count_if(~blank(c) & parse.PARSERS[f.data_type](c).isNull())))
        wide = df.agg(*(x.cast("bigint").alias(f"t{i}") for i, (_, _, x) in enumerate(tests)))
        rows = F.array(*(F.struct(F.lit(e.name).alias("entity"), F.lit(n).alias("field"), F.lit(k).alias("check"), F.col(f"t{i}").alias("n")) for i, (n, k, _) in enumerate(tests)))
        parts.append(wide.select(F.inline(rows)))
        if e.primary_key and e.primary_key in df.columns:
            parts.append(duplicate_keys(df, e.primary_key).select(F.lit(e.name).alias("entity"), F.lit(e.primary_key).alias("field"), F.lit("unique").alias("check"), "n"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """n: occurrences of a key value beyond its first."""
    return df.where(q(key).isNotNull()).groupBy(q(key)).agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n"))


def relationship_errors(spec: Dataset, tables: dict[str, DataFrame]) -> DataFrame | None:
    """parent, child, check, n; a null child key has no parent."""
    parts = []
    for r in spec.relationships:
        child, parent = tables[r.child_entity], tables[r.parent_entity]
        missing = orphans(child, r.child_field, parent, r.parent_field).agg(F.count("*").alias("n"))
        named = lambda df, check, r=r: df.select(
            F.lit(f"{r.parent_entity}.{r.parent_field}").alias("parent"), F.lit(f"{r.child_entity}.{r.child_field}").alias("child"), F.lit(check).alias("check"), "n"
        )
        parts.append(named(missing, "orphans"))
        if r.kind == "one_to_one":
            parts.append(named(duplicate_keys(child, r.child_field), "repeated"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def constraint_errors(spec: Dataset, tables: dict[str, DataFrame]) -> DataFrame | None:
    """constraint, kind, n: failing rows of each constraint; here a null end of a time order fails.

    One scan of each table for all its row constraints; aggregates are joined each.
    """
    parts, by_table = [], {}
    for i, c in enumerate(spec.constraints):
        if c.kind == "formula":
            bad = ~formula.close(formula.number(c.target), formula.parse(c.expression).column(), c.tolerance)
        elif c.kind == "temporal":
            s, e = q(c.start).try_cast("timestamp"), q(c.end).try_cast("timestamp")
            bad = ~F.coalesce(s <= e, F.lit(False))
        elif c.kind == "conditional_required":
            bad = F.coalesce(q(c.condition_field).cast("string") == F.lit(str(c.condition_value)), F.lit(False)) & blank(q(c.required_field))
        else:
            r = next((r for r in spec.relationships if (r.parent_entity, r.child_entity) == (c.entity, c.child_entity)), None)
            if r is not None:
                df = tables[c.entity].join(aggregated(tables[c.child_entity], r.child_field, c.child_field, c.aggregate or "sum"), q(r.parent_field) == F.col("__key"), "left")
                bad = ~formula.close(formula.number(c.target), F.coalesce("__value", F.lit(0.0)), max(c.tolerance, 1e-6))
                parts.append(_failures(df, [(i, c.kind, bad)]))
            continue
        by_table.setdefault(c.entity, []).append((i, c.kind, bad))
    parts = [_failures(tables[name], tests) for name, tests in by_table.items()] + parts
    return reduce(DataFrame.unionByName, parts) if parts else None


def _failures(df: DataFrame, tests: list[tuple]) -> DataFrame:
    wide = df.agg(*(F.count_if(bad).alias(f"t{i}") for i, _, bad in tests))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(i).alias("constraint"), F.lit(kind).alias("kind"), F.col(f"t{i}").alias("n")) for i, kind, _ in tests))))


def assert_spec_safe(spec: Dataset) -> None:
    """A sensitive field carries no source statistics or literal values."""
    for e in spec.entities:
        for f in e.fields:
            if not (f.sensitive or privacy.sensitive_field(f.name, f.semantic_type)) or f.is_identifier:
                continue
            d = f.distribution or {}
            if d.get("kind") in ("categorical", "string_pattern") and f.data_type == "string" and not f.sensitive:
                raise SpecError(f"{e.name}.{f.name}: a sensitive field must be marked sensitive")
            if d.get("kind") == "categorical":
                raise SpecError(f"{e.name}.{f.name}: a sensitive field keeps no categories")
            if d.get("kind") == "numeric" and d.get("scale_factor", 1.0) == 1.0:
                raise SpecError(f"{e.name}.{f.name}: bounds of a sensitive number must be scaled")
            for p in d.get("patterns", []) if d.get("kind") == "masked_patterns" else ():
                if not _is_mask(p["pattern"]):
                    raise SpecError(f"{e.name}.{f.name}: a pattern is not masked")
    for c in spec.constraints:
        if c.kind == "conditional_required" and privacy.sensitive_name(c.condition_field):
            raise SpecError(f"{c.entity}.{c.condition_field}: no condition on a sensitive field")


def _is_mask(text: str) -> bool:
    return text in (*privacy.SENSITIVE_TYPES, "text") or text.startswith("text_len_") and text[9:].isdigit()


def row_digest(df: DataFrame, columns: list[str]):
    """SHA-256 of a row's cells as text; null and blank are alike."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(q(c).cast("string"), F.lit("")) for c in columns))), 256)


def reused_rows(generated: DataFrame, source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Generated rows that equal a source row in all shared columns."""
    columns = columns or [c for c in generated.columns if c in source.columns and c not in (ROW, INVALID)]
    held = source.select(row_digest(source, columns).alias("__digest")).distinct()
    return generated.withColumn("__digest", row_digest(generated, columns)).join(held, "__digest", "left_semi").drop("__digest")


def assert_no_reuse(generated: DataFrame, source: DataFrame) -> None:
    if not reused_rows(generated, source).isEmpty():
        raise SpecError("generated rows repeat source rows")


SECTIONS = ("schema", "relationships", "constraints", "privacy")


def validate(spec: Dataset, tables: dict[str, DataFrame], sections: tuple[str, ...] = SECTIONS, fail_fast: bool = False) -> dict[str, Any]:
    """A report by section: passed and the errors as text."""
    out: dict[str, Any] = {}

    def schema() -> list[str]:
        names = {e.name for e in spec.entities}
        errors = [f"unexpected entity {n}" for n in sorted(set(tables) - names)] + [f"missing entity {n}" for n in sorted(names - set(tables))]
        for e in spec.entities:
            if e.name in tables:
                own, want = {c for c in tables[e.name].columns if c not in (ROW, INVALID, "__broken")}, {f.name for f in e.fields}
                errors += [f"{e.name}: fields differ: {sorted(own ^ want)}"] if own != want else []
        found = schema_errors(spec, tables)
        return errors + [f"{r['entity']}.{r['field']}: {r['check']} fails {r['n']} times" for r in (found.where("n > 0").collect() if found is not None else [])]

    def relationships() -> list[str]:
        found = relationship_errors(spec, tables)
        return [f"{r['child']} -> {r['parent']}: {r['n']} {r['check']}" for r in (found.where("n > 0").collect() if found is not None else [])]

    def constraints() -> list[str]:
        found = constraint_errors(spec, tables)
        return [f"constraint {r['constraint']} ({r['kind']}): {r['n']} rows" for r in (found.where("n > 0").collect() if found is not None else [])]

    def private() -> list[str]:
        try:
            assert_spec_safe(spec)
        except SpecError as e:
            return [str(e)]
        return []

    checks = {"schema": schema, "relationships": relationships, "constraints": constraints, "privacy": private}
    for name in SECTIONS:
        if name in sections:
            errors = checks[name]()
            out[name] = {"passed": not errors, "errors": errors}
            if errors and fail_fast:
                break
    return {"passed": all(s["passed"] for s in out.values()), "sections": out}


#: fixed values: what generated sensitive text looks like
SYNTHETIC = r"^(user_[0-9a-f]{12}@example\.test|\+1-202-555-01[0-9]{2}|000-00-[0-9]{4}|synthetic_.*)$"


def unsafe_values(spec: Dataset, tables: dict[str, DataFrame]) -> DataFrame | None:
    """entity, field, n: sensitive texts that aren't of a synthetic form after everything is solved."""
    parts = []
    for e in spec.entities:
        names = [f.name for f in e.fields if f.sensitive and f.data_type == "string" and not f.is_identifier]
        if names and e.name in tables:
            wide = tables[e.name].agg(*(F.count_if(~blank(q(n)) & ~q(n).rlike(SYNTHETIC)).alias(f"t{i}") for i, n in enumerate(names)))
            parts.append(wide.select(F.inline(F.array(*(F.struct(F.lit(e.name).alias("entity"), F.lit(n).alias("field"), F.col(f"t{i}").alias("n")) for i, n in enumerate(names))))))
    return reduce(DataFrame.unionByName, parts) if parts else None


def assert_profile_safe(profile: Dataset) -> None:
    """A profile of sensitive fields holds masked patterns or shapes only, and no conditions on them."""
    for e in profile.entities:
        for f in e.fields:
            if f.is_identifier or not (f.sensitive or privacy.sensitive_field(f.name, f.semantic_type)):
                continue
            if (f.distribution or {}).get("kind") not in (None, "masked_patterns", "numeric_shape", "boolean", "date_range", "datetime_range"):
                raise SpecError(f"{e.name}.{f.name}: a sensitive field carries {f.distribution['kind']}")
            for p in (f.distribution or {}).get("patterns", []):
                if not _is_mask(p["pattern"]):
                    raise SpecError(f"{e.name}.{f.name}: a pattern is not masked")


def assert_solved_safe(spec: Dataset, tables: dict[str, DataFrame]) -> None:
    """After everything is solved: every sensitive text is of a synthetic form.  Reads all rows once."""
    found = unsafe_values(spec, tables)
    bad = [] if found is None else found.where("n > 0").collect()
    if bad:
        raise SpecError("; ".join(f"{r['entity']}.{r['field']}: {r['n']} values aren't synthetic" for r in bad))


# budgets

#: fixed values: the most that one run may ask for
LIMITS = {
    "rows_per_entity": 100_000, "output_bytes": 512 << 20, "input_rows": 1_000_000, "input_cells": 10_000_000, "columns": 1_000, "files": 100, "input_bytes": 512 << 20,
    "file_bytes": 128 << 20,
}
_WIDTH = {"integer": 20, "float": 24, "boolean": 5, "date": 10, "datetime": 32, "string": 64}


def _within(limits: dict[str, int], what: str, name: str, n: int) -> None:
    if n > limits.get(name, n):
        raise SpecError(f"{what}: {n} {name.replace('_', ' ')}; at most {limits[name]}")


def estimated_bytes(spec: Dataset) -> int:
    """Text size of all tables of a specification."""
    return sum(e.row_count * sum(_WIDTH[f.data_type] + 1 for f in e.fields) for e in spec.entities)


def assert_budget(spec: Dataset, limits: dict[str, int] | None = None) -> None:
    """Refuses a specification beyond the limits; pass larger ones (or {}) on a cluster."""
    limits = LIMITS if limits is None else limits
    for e in spec.entities:
        _within(limits, e.name, "rows_per_entity", e.row_count)
        _within(limits, e.name, "columns", len(e.fields))
    _within(limits, "the tables", "output_bytes", estimated_bytes(spec))


def assert_input_budget(spark, folder: str, tables: dict[str, DataFrame], limits: dict[str, int] | None = None) -> None:
    """Refuses a folder beyond the limits: files and bytes before anything is read, then rows and cells."""
    limits = LIMITS if limits is None else limits
    at, fs = file_system(spark, folder)
    sizes = {str(s.getPath().getName()): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(at)}
    _within(limits, folder, "files", len(sizes))
    _within(limits, folder, "input_bytes", sum(sizes.values()))
    for name, size in sizes.items():
        _within(limits, name, "file_bytes", size)
    for name, df in tables.items():
        _within(limits, name, "columns", len(df.columns))
        if "input_rows" in limits or "input_cells" in limits:
            n = df.count()
            _within(limits, name, "input_rows", n)
            _within(limits, name, "input_cells", n * len(df.columns))

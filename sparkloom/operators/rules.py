"""Business rules: field, row and cross-table rules applied to, broken in and checked on tables.

A rule compiles to Column expressions; applying is a chain of projections, checking one
aggregation a table for all its field and row rules, cross-table rules an anti-join or
a one-row aggregate each.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import draws, formula, privacy
from sparkloom.functions.draws import ROW
from sparkloom.model import Dataset, SpecError
from sparkloom.operators.profile import q

MOST_RULES, MOST_EVALUATIONS, ERRORS_PER_RULE, ERRORS = 1000, 5_000_000, 100, 1000
#: fixed values: what a required text gets, and what no rule allows
REQUIRED, NOT_ALLOWED = "required", "__invalid__"


@dataclass
class Condition:
    field: str
    equals: Any = None
    not_equals: Any = None
    in_values: list | None = None

    def __post_init__(self):
        if self.equals is None and self.not_equals is None and not self.in_values:
            raise SpecError(f"condition on {self.field} tests nothing")

    def column(self) -> Column:
        c, out = q(self.field), F.lit(True)
        if self.equals is not None:
            out = out & same(c, self.equals)
        if self.not_equals is not None:
            out = out & ~same(c, self.not_equals)
        if self.in_values:
            out = out & reduce(Column.__or__, (same(c, v) for v in self.in_values))
        return out


def same(c: Column, value) -> Column:
    """Equality as between plain values: numbers and booleans compare with each other, text only with text; null is no value."""
    if isinstance(value, str):
        return F.coalesce(c.cast("string") == F.lit(value), F.lit(False))
    return F.coalesce(c.try_cast("double") == F.lit(float(value)), F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


@dataclass
class FieldRule:
    table: str
    field: str
    required: bool = False
    allowed_values: list | None = None
    min_value: float | None = None
    max_value: float | None = None
    kind: str = "field"

    def __post_init__(self):
        if self.min_value is not None and self.max_value is not None and self.min_value > self.max_value:
            raise SpecError(f"{self.table}.{self.field}: minimum above maximum")


@dataclass
class ConditionalRequired:
    table: str
    when: Condition
    required_fields: list[str]
    kind: str = "conditional_required"


@dataclass
class ConditionalAllowed:
    table: str
    when: Condition
    field: str
    allowed_values: list
    kind: str = "conditional_allowed_values"


@dataclass
class TemporalOrdering:
    table: str
    start_field: str
    end_field: str
    allow_equal: bool = True
    kind: str = "temporal_ordering"


@dataclass
class FormulaRule:
    table: str
    field: str
    expression: str
    tolerance: float = 1e-6
    kind: str = "formula"


@dataclass
class ForeignKeyRule:
    child_table: str
    child_field: str
    parent_table: str
    parent_field: str
    kind: str = "foreign_key"


@dataclass
class AggregateRule:
    table: str
    field: str
    expression: str
    expected: float | None = None
    tolerance: float = 1e-6
    kind: str = "aggregate_formula"


@dataclass
class Scenario:
    name: str
    weight: float
    field_values: dict[str, dict[str, Any]] = field(default_factory=dict)


KINDS = {
    "field": FieldRule, "conditional_required": ConditionalRequired, "conditional_allowed_values": ConditionalAllowed,
    "temporal_ordering": TemporalOrdering, "formula": FormulaRule, "foreign_key": ForeignKeyRule, "aggregate_formula": AggregateRule,
}


@dataclass
class Rules:
    field_rules: list[FieldRule] = field(default_factory=list)
    row_rules: list = field(default_factory=list)
    cross_table_rules: list = field(default_factory=list)
    scenarios: list[Scenario] = field(default_factory=list)

    def __post_init__(self):
        if len(self.all()) + len(self.scenarios) > MOST_RULES:
            raise SpecError(f"more than {MOST_RULES} rules")

    def all(self) -> list:
        return [*self.field_rules, *self.row_rules, *self.cross_table_rules]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def rules_from_dict(payload: dict[str, Any]) -> Rules:
    """Unknown keys and kinds are refused."""
    if extra := set(payload) - {"field_rules", "row_rules", "cross_table_rules", "scenarios"}:
        raise SpecError(f"unknown rule sections {sorted(extra)}")

    def one(kind, body: dict) -> Any:
        body = dict(body)
        body.pop("kind", None)
        if "when" in body:
            body["when"] = Condition(**body["when"])
        try:
            return kind(**body)
        except TypeError as e:
            raise SpecError(str(e)) from e

    def by_kind(body: dict) -> Any:
        if body.get("kind") not in KINDS:
            raise SpecError(f"unknown rule kind {body.get('kind')}")
        return one(KINDS[body["kind"]], body)

    return Rules(
        [one(FieldRule, b) for b in payload.get("field_rules", [])],
        [by_kind(b) for b in payload.get("row_rules", [])],
        [by_kind(b) for b in payload.get("cross_table_rules", [])],
        [one(Scenario, b) for b in payload.get("scenarios", [])],
    )


# contract


def check_contract(rules: Rules, spec: Dataset) -> int:
    """Every reference exists, bounds are on numbers, no literal is sensitive; returns the row evaluations needed."""
    cost = 0
    for r in rules.all():
        table = getattr(r, "table", None) or r.child_table
        own = spec[table]
        names = [getattr(r, n) for n in ("field", "start_field", "end_field", "child_field") if getattr(r, n, None) not in (None, "*")]
        names += list(getattr(r, "required_fields", [])) + ([r.when.field] if hasattr(r, "when") else [])
        if r.kind == "formula":
            names += formula.parse(r.expression).names
        if r.kind == "aggregate_formula":
            formula.parse(r.expression, aggregates=True)
        for n in names:
            own[n]
        if r.kind == "foreign_key":
            spec[r.parent_table][r.parent_field]
            cost += spec[r.parent_table].row_count
        if r.kind == "field" and (r.min_value is not None or r.max_value is not None) and own[r.field].data_type not in ("integer", "float"):
            raise SpecError(f"{table}.{r.field}: bounds need a number")
        literals = list(getattr(r, "allowed_values", None) or [])
        if hasattr(r, "when"):
            literals += [v for v in (r.when.equals, r.when.not_equals, *(r.when.in_values or [])) if v is not None]
        _check_literals(table, names, literals)
        cost += own.row_count
    for s in rules.scenarios:
        for table, values in s.field_values.items():
            for n, v in values.items():
                spec[table][n]
                _check_literals(table, [n], [v])
    if cost > MOST_EVALUATIONS:
        raise SpecError(f"{cost} rule evaluations; at most {MOST_EVALUATIONS}")
    return cost


def _check_literals(table: str, names: list[str], literals: list) -> None:
    for n in names:
        if literals and privacy.sensitive_name(n):
            raise SpecError(f"{table}.{n}: a sensitive field takes no literal values")


# applying


def _default(r: FieldRule, kind) -> Column:
    value = r.allowed_values[0] if r.allowed_values else r.min_value if r.min_value is not None else None
    if value is None:
        value = {"string": REQUIRED}.get(kind.simpleString(), 0 if kind.simpleString() in ("bigint", "int", "double") else None)
    return F.lit(value).cast(kind)


def apply_valid(tables: dict[str, DataFrame], rules: Rules) -> dict[str, DataFrame]:
    """Repairs what can be repaired; bounds, keys and aggregates can't."""
    out = dict(tables)
    for r in [*rules.field_rules, *rules.row_rules]:
        df = out[r.table]
        if r.kind == "field":
            kind, c = df.schema[r.field].dataType, q(r.field)
            if r.required:
                c = F.when(blank(c), _default(r, kind)).otherwise(c)
            if r.allowed_values:
                good = reduce(Column.__or__, (same(c, v) for v in r.allowed_values))  # a null isn't among them
                c = F.when(~good, F.lit(r.allowed_values[0]).cast(kind)).otherwise(c)
            df = df.withColumn(r.field, c)
        elif r.kind == "conditional_required":
            for n in r.required_fields:
                fill = _default(next((f for f in rules.field_rules if (f.table, f.field) == (r.table, n)), FieldRule(r.table, n)), df.schema[n].dataType)
                df = df.withColumn(n, F.when(r.when.column() & blank(q(n)), fill).otherwise(q(n)))
        elif r.kind == "conditional_allowed_values":
            good = reduce(Column.__or__, (same(q(r.field), v) for v in r.allowed_values))
            df = df.withColumn(r.field, F.when(r.when.column() & ~good, F.lit(r.allowed_values[0]).cast(df.schema[r.field].dataType)).otherwise(q(r.field)))
        elif r.kind == "temporal_ordering":
            s, e = q(r.start_field), q(r.end_field)
            df = df.withColumn(r.end_field, F.when(_time(s).isNotNull() & (_time(e).isNull() | (_time(s) > _time(e))), s.cast(df.schema[r.end_field].dataType)).otherwise(e))
        elif r.kind == "formula":
            value = formula.parse(r.expression).column()
            df = df.withColumn(r.field, F.coalesce(value.cast(df.schema[r.field].dataType), q(r.field)))
        out[r.table] = df
    return out


def _time(c: Column) -> Column:
    return c.try_cast("timestamp")


def apply_edges(tables: dict[str, DataFrame], rules: Rules) -> dict[str, DataFrame]:
    """Row 0 takes each field's minimum and row 1 its maximum."""
    out = dict(tables)
    for r in rules.field_rules:
        df, kind = out[r.table], out[r.table].schema[r.field].dataType
        c = q(r.field)
        for row, bound in ((0, r.min_value), (1, r.max_value)):
            if bound is not None:
                c = F.when(F.col(ROW) == row, F.lit(bound).cast(kind)).otherwise(c)
        out[r.table] = df.withColumn(r.field, c)
    return out


def apply_scenarios(tables: dict[str, DataFrame], scenarios: list[Scenario], seed: int) -> dict[str, DataFrame]:
    """Each row of each table draws one scenario by weight and takes its literals."""
    if not scenarios:
        return dict(tables)
    out = {}
    for table, df in tables.items():
        pick = draws.weighted(draws.uniform(seed, table, "", "scenario"), list(range(len(scenarios))), [s.weight for s in scenarios])
        df = df.withColumn("__scenario", pick)
        for n in {n for s in scenarios for n in s.field_values.get(table, {})}:
            c = q(n)
            for i, s in enumerate(scenarios):
                if n in s.field_values.get(table, {}):
                    c = F.when(F.col("__scenario") == i, F.lit(s.field_values[table][n]).cast(df.schema[n].dataType)).otherwise(c)
            df = df.withColumn(n, c)
        out[table] = df.drop("__scenario")
    return out


# breaking


def cases(table: str, rules: Rules) -> list[tuple[str, Any, str | None]]:
    """Ways to break the rules of a table: (kind, rule, field)."""
    out = []
    for r in rules.field_rules:
        if r.table == table:
            out += [("required", r, None)] if r.required else []
            out += [("allowed_values", r, None)] if r.allowed_values else []
            out += [("min_value", r, None)] if r.min_value is not None else []
            out += [("max_value", r, None)] if r.max_value is not None else []
    for r in rules.row_rules:
        if r.table == table:
            out += [(r.kind, r, n) for n in r.required_fields] if r.kind == "conditional_required" else [(r.kind, r, None)]
    for r in rules.cross_table_rules:
        if r.kind == "foreign_key" and r.child_table == table or r.kind == "aggregate_formula" and r.table == table and r.field != "*":
            out.append((r.kind, r, None))
    return out


def break_rules(tables: dict[str, DataFrame], rules: Rules, seed: int, ratio: float = 1.0) -> dict[str, DataFrame]:
    """Selected rows (a draw of at most ratio) break the table's cases in turn.

    ``__broken`` holds the case's number, null for rows left alone; columns that must
    hold a value of another type come as text.  Bounds beyond which a number must lie
    are the next doubles.  An aggregate is broken in the first selected row only.
    """
    out = {}
    for table, df in tables.items():
        held = cases(table, rules)
        if not held:
            out[table] = df.withColumn("__broken", F.lit(None).cast("int"))
            continue
        chosen = draws.uniform(seed, table, "", "break") <= ratio
        # the place among the selected rows: counts by stretch of rows, then within; the one window without a key adds up a
        # number for each 65,536 rows, 24 bytes each (some 4 MB for 10 billion rows)
        stretch = df.withColumn("__hit", chosen).withColumn("__part", F.floor(F.col(ROW) / 65536))
        counts = stretch.where("__hit").groupBy("__part").agg(F.count("*").alias("__k"))
        before = counts.withColumn("__before", F.coalesce(F.sum("__k").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.sum(F.col("__hit").cast("int")).over(Window.partitionBy("__part").orderBy(ROW)) - 1
        marked = stretch.withColumn("__within", within).join(before.select("__part", "__before"), "__part", "left")
        offset = int(hashlib.sha256(f"{seed}|{table}".encode()).hexdigest()[:8], 16) % len(held)
        case = F.pmod(F.col("__within") + F.coalesce("__before", F.lit(0)) + offset, F.lit(len(held))).cast("int")
        marked = marked.withColumn("__broken", F.when(F.col("__hit"), case))
        firsts = {}
        if any(k == "aggregate_formula" for k, _, _ in held):
            firsts = {r["__broken"]: r["r"] for r in marked.groupBy("__broken").agg(F.min(ROW).alias("r")).where("__broken IS NOT NULL").collect()}
        for i, (kind, rule, name) in enumerate(held):
            marked = _break(marked, F.col("__broken") == i, kind, rule, name, tables, firsts.get(i))
        out[table] = marked.select(*(q(c) for c in df.columns), "__broken")
    return out


def _set(df: DataFrame, hit: Column, name: str, value: Column, text: bool = False) -> DataFrame:
    kind = df.schema[name].dataType
    if text and kind.simpleString() != "string":
        return df.withColumn(name, F.when(hit, value.cast("string")).otherwise(q(name).cast("string")))
    return df.withColumn(name, F.when(hit, value.cast(kind)).otherwise(q(name)))


def _outside(allowed: list) -> Column:
    value = NOT_ALLOWED
    while value in allowed:
        value += "_"
    return F.lit(value)


def _force(df: DataFrame, hit: Column, when: Condition) -> DataFrame:
    wanted = when.equals if when.equals is not None else when.in_values[0] if when.in_values else None
    if wanted is None:
        return df  # not_equals alone: null and any other value match already
    return _set(df, hit & ~when.column(), when.field, F.lit(wanted))


def _break(df: DataFrame, hit: Column, kind: str, r, name: str | None, tables: dict[str, DataFrame], first: int | None) -> DataFrame:
    if kind == "required":
        return _set(df, hit, r.field, F.lit(None))
    if kind == "allowed_values":
        return _set(df, hit, r.field, _outside(r.allowed_values), text=True)
    if kind in ("min_value", "max_value"):
        bound, way = (r.min_value, -math.inf) if kind == "min_value" else (r.max_value, math.inf)
        whole = df.schema[r.field].dataType.simpleString() in ("bigint", "int")
        value = (math.ceil(bound) - 1 if way < 0 else math.floor(bound) + 1) if whole else math.nextafter(bound, way)
        return _set(df, hit, r.field, F.lit(value))
    if kind == "conditional_required":
        return _set(_force(df, hit, r.when), hit, name, F.lit(None))
    if kind == "conditional_allowed_values":
        return _set(_force(df, hit, r.when), hit, r.field, _outside(r.allowed_values), text=True)
    if kind == "temporal_ordering":
        start = F.coalesce(_time(q(r.start_field)), F.lit("2000-01-02").cast("timestamp"))
        df = _set(df, hit, r.start_field, start)
        day = df.schema[r.end_field].dataType.simpleString() == "date"
        return _set(df, hit, r.end_field, _time(q(r.start_field)) - F.expr("INTERVAL 1 DAY" if day else "INTERVAL 1 MICROSECOND"))
    if kind == "formula":
        return _set(df, hit, r.field, F.coalesce(formula.number(r.field), F.lit(0.0)) + max(1.0, 2 * r.tolerance))
    if kind == "foreign_key":
        top = tables[r.parent_table].agg(F.max(q(r.parent_field)).alias("m")).first()["m"]
        if isinstance(top, bool) or not isinstance(top, (int, float)):
            return _set(df, hit, r.child_field, F.lit(NOT_ALLOWED), text=True)
        return _set(df, hit, r.child_field, F.lit(top + 1 if isinstance(top, int) else math.nextafter(top, math.inf)))
    return df if first is None else _set(df, hit & (F.col(ROW) == first), r.field, F.coalesce(formula.number(r.field), F.lit(0.0)) + max(1.0, 2 * r.tolerance))


def apply(tables: dict[str, DataFrame], rules: Rules, seed: int = 0, mode: str = "valid", invalid_ratio: float = 0.0) -> dict[str, DataFrame]:
    """Scenarios, then valid defaults, then the mode's edges or breakages.  Tables carry ROW."""
    out = apply_valid(apply_scenarios(tables, rules.scenarios, seed), rules)
    if mode == "edge":
        out = apply_edges(out, rules)
    if mode in ("mixed", "negative"):
        out = break_rules(out, rules, seed, 1.0 if mode == "negative" else invalid_ratio)
    return out


# checking


def failure(r) -> tuple[Column, Column]:
    """Whether a row is under a field or row rule, and whether it then fails."""
    if r.kind == "field":
        c, none = q(r.field), blank(q(r.field))
        bad = none if r.required else F.lit(False)
        if r.allowed_values:
            bad = bad | (~none & ~reduce(Column.__or__, (same(c, v) for v in r.allowed_values)))
        x = c.try_cast("double")
        for bound, over in ((r.min_value, lambda b: x < b), (r.max_value, lambda b: x > b)):
            if bound is not None:
                bad = bad | (~none & F.coalesce(over(bound), F.lit(True)))
        return F.lit(True), bad
    if r.kind == "conditional_required":
        return r.when.column(), reduce(Column.__or__, (blank(q(n)) for n in r.required_fields))
    if r.kind == "conditional_allowed_values":
        return r.when.column(), ~reduce(Column.__or__, (same(q(r.field), v) for v in r.allowed_values))
    if r.kind == "temporal_ordering":
        s, e = _time(q(r.start_field)), _time(q(r.end_field))
        return F.lit(True), ~F.coalesce(s <= e if r.allow_equal else s < e, F.lit(False))
    return F.lit(True), ~formula.close(formula.number(r.field), formula.parse(r.expression).column(), r.tolerance)


def _result(df: DataFrame, index: int, r) -> DataFrame:
    return df.select(F.lit(index).alias("rule"), F.lit(r.kind).alias("kind"), F.col("checked").cast("bigint"), F.col("failed").cast("bigint"))


def validate(tables: dict[str, DataFrame], rules: Rules) -> DataFrame:
    """rule, kind, checked, failed: one row for each rule, one scan of each table for all its own rules."""
    parts, numbered = [], list(enumerate(rules.all()))
    for table, df in tables.items():
        own = [(i, r) for i, r in numbered if r.kind not in ("foreign_key", "aggregate_formula") and r.table == table]
        if not own:
            continue
        tests = [failure(r) for _, r in own]
        wide = df.agg(*(x for j, (under, bad) in enumerate(tests) for x in (F.count_if(under).alias(f"c{j}"), F.count_if(under & bad).alias(f"f{j}"))))
        rows = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(r.kind).alias("kind"), F.col(f"c{j}").alias("checked"), F.col(f"f{j}").alias("failed")) for j, (i, r) in enumerate(own)))
        parts.append(wide.select(F.inline(rows)))
    for i, r in numbered:
        if r.kind == "foreign_key":
            keys = tables[r.parent_table].select(q(r.parent_field).alias("__key")).distinct().withColumn("__met", F.lit(1))
            rows = tables[r.child_table].select(q(r.child_field).alias("__child")).groupBy("__child").agg(F.count("*").alias("__n"))
            joined = rows.join(keys, F.col("__child").eqNullSafe(F.col("__key")), "left")
            n = F.coalesce(F.sum(F.when(F.col("__met").isNull(), F.col("__n"))), F.lit(0))
            parts.append(_result(joined.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("checked"), n.alias("failed")), i, r))
        elif r.kind == "aggregate_formula":
            df = tables[r.table]
            actual = F.count("*").cast("double") if r.field == "*" else F.sum(F.coalesce(formula.number(r.field), F.lit(0.0)))
            want = F.lit(float(r.expected)) if r.expected is not None else formula.parse(r.expression, aggregates=True).column(lambda n: F.first(formula.number(n)))
            bad = F.when(formula.close(F.coalesce(actual, F.lit(0.0)), F.coalesce(want, F.lit(0.0)), r.tolerance), 0).otherwise(1)
            parts.append(_result(df.agg(F.lit(1).alias("checked"), bad.alias("failed")), i, r))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "rule int, kind string, checked bigint, failed bigint")
    return reduce(DataFrame.unionByName, parts)


def report(tables: dict[str, DataFrame], rules: Rules) -> dict[str, Any]:
    """Bounded report: every rule's counts, and the rows that fail (at most 100 a rule, 1,000 in all) where rows are numbered."""
    results, left = [], ERRORS
    counted = {r["rule"]: r for r in validate(tables, rules).collect()}
    for i, r in enumerate(rules.all()):
        got, rows = counted[i], []
        if got["failed"] and left and r.kind not in ("foreign_key", "aggregate_formula") and ROW in tables[r.table].columns:
            under, bad = failure(r)
            rows = [x[0] for x in tables[r.table].where(under & bad).select(ROW).orderBy(ROW).limit(min(ERRORS_PER_RULE, left)).collect()]
            left -= len(rows)
        results.append({"rule": i, "kind": r.kind, "checked": got["checked"], "failed": got["failed"], "passed": not got["failed"], "rows": rows})
    return {"passed": all(r["passed"] for r in results), "results": results}

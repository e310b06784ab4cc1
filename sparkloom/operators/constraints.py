"""Mining of formulas, time orders, conditional requirements and aggregate columns.

Every candidate is a conditional count; all candidates of a table are counted in one
aggregation (in chunks of CHUNK expressions, as formulas grow with the cube of the
numeric columns).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import formula, parse
from sparkloom.model import Constraint
from sparkloom.operators.profile import identifier_name, q

ACCEPTED, LIFT, MOST_CONDITIONS, TOLERANCE, CHUNK = 0.9, 0.2, 10, 1e-6, 400


def _counted(df: DataFrame, tests: list[tuple[dict, Column, Column]], columns: list[str]) -> DataFrame:
    """One row for each test: its description, checked, passed; rows are scanned once for each chunk."""
    parts = []
    for lo in range(0, len(tests), CHUNK):
        part = tests[lo : lo + CHUNK]
        wide = df.agg(*(x for i, (_, checked, passed) in enumerate(part) for x in (F.count_if(checked).alias(f"c{i}"), F.count_if(checked & passed).alias(f"p{i}"))))
        rows = F.array(
            *(
                F.struct(F.lit(lo + i).alias("rank"), *(F.lit(d[c]).cast("string").alias(c) for c in columns), F.col(f"c{i}").alias("checked"), F.col(f"p{i}").alias("passed"))
                for i, (d, _, _) in enumerate(part)
            )
        )
        parts.append(wide.select(F.inline(rows)))
    if not parts:
        schema = ", ".join(["rank int", *(f"{c} string" for c in columns), "checked bigint", "passed bigint", "confidence double"])
        return df.sparkSession.createDataFrame([], schema)
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("confidence", F.when(F.col("checked") == 0, F.lit(0.0)).otherwise(F.round(F.col("passed") / F.col("checked"), 6)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not identifier_name(f.name) and _is(f, "integer", "float")]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if _is(f, "date", "datetime")]


def _is(f, *kinds: str) -> bool:
    try:
        return parse.logical_type(f.dataType) in kinds
    except TypeError:
        return False


def formula_candidates(df: DataFrame, columns: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """rank, target, expression, checked, passed, confidence for ``l * r`` and ``l + r`` of each pair."""
    columns = columns or numeric_columns(df)
    tests = []
    for target in columns:
        for a, b in combinations([c for c in columns if c != target], 2):
            t, x, y = (formula.number(c) for c in (target, a, b))
            have = t.isNotNull() & x.isNotNull() & y.isNotNull()
            for op, value in (("*", x * y), ("+", x + y)):
                tests.append(({"target": target, "expression": f"{a} {op} {b}"}, have, formula.close(t, value, tolerance)))
    return _counted(df, tests, ["target", "expression"])


def temporal_candidates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rank, start_field, end_field, checked, passed, confidence for both directions of each pair."""
    columns = columns or temporal_columns(df)
    tests = []
    for a, b in combinations(columns, 2):
        for s, e in ((a, b), (b, a)):
            tests.append(({"start_field": s, "end_field": e}, q(s).isNotNull() & q(e).isNotNull(), F.coalesce(q(s) <= q(e), F.lit(False))))
    return _counted(df, tests, ["start_field", "end_field"])


def present(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def conditional_candidates(df: DataFrame, conditions: list[str], required: list[str] | None = None) -> DataFrame:
    """condition_field, condition_value, required_field, n, confidence, lift over the field's overall presence."""
    required = required or list(df.columns)
    if not conditions:
        return df.sparkSession.createDataFrame([], "condition_field string, condition_value string, required_field string, n bigint, confidence double, lift double")
    keyed = df.select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("condition_field"), q(c).cast("string").alias("condition_value")) for c in conditions))),
        *(present(q(f)).cast("int").alias(f"f{i}") for i, f in enumerate(required)),
    )
    # grouping sets by hand: every condition column and the whole table in one shuffle of counts
    per = keyed.groupBy("condition_field", "condition_value").agg(F.count("*").alias("n"), *(F.sum(f"f{i}").alias(f"s{i}") for i in range(len(required))))
    long = per.select(
        "condition_field", "condition_value", "n",
        F.inline(F.array(*(F.struct(F.lit(f).alias("required_field"), F.col(f"s{i}").alias("met")) for i, f in enumerate(required)))),
    )
    overall = long.groupBy("condition_field", "required_field").agg((F.sum("met") / F.sum("n")).alias("base"))
    return (
        long.where("condition_value IS NOT NULL AND condition_value <> '' AND condition_field <> required_field")
        .join(overall, ["condition_field", "required_field"])
        .select(
            "condition_field", "condition_value", "required_field", "n", F.round(F.col("met") / F.col("n"), 6).alias("confidence"),
            F.round(F.col("met") / F.col("n") - F.col("base"), 6).alias("lift"),
        )
    )


def aggregate_candidates(columns: dict[str, list[str]]) -> list[Constraint]:
    """Parent columns named ``<child>_<field>_total``, ``_average`` or ``_avg``."""
    out = []
    for child, fields in columns.items():
        for f in fields:
            for suffix, how in (("total", "sum"), ("average", "avg"), ("avg", "avg")):
                for parent, own in columns.items():
                    if parent != child and f"{child}_{f}_{suffix}" in own:
                        out.append(Constraint("aggregate_mapping", parent, target=f"{child}_{f}_{suffix}", child_entity=child, child_field=f, aggregate=how, confidence=0.8))
    return out


def mine(tables: dict[str, DataFrame], all_hits: bool = False) -> list[Constraint]:
    """Constraints of a set of tables; by default one formula for each table, the first in column order."""
    out = []
    for name, df in tables.items():
        held = formula_candidates(df).where(F.col("confidence") >= ACCEPTED).orderBy("rank")
        for r in held.collect() if all_hits else held.limit(1).collect():
            out.append(Constraint("formula", name, target=r["target"], expression=r["expression"], confidence=r["confidence"]))
        seen = set()
        for r in temporal_candidates(df).where(F.col("confidence") >= ACCEPTED).orderBy("rank").collect():
            if (pair := frozenset((r["start_field"], r["end_field"]))) not in seen:
                seen.add(pair)
                out.append(Constraint("temporal", name, start=r["start_field"], end=r["end_field"], confidence=r["confidence"]))
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and not identifier_name(f.name)]
        if texts:
            sizes = df.agg(*(F.approx_count_distinct(q(c)).alias(c) for c in texts)).first()
            nullable = df.agg(*(F.count_if(~present(q(c))).alias(c) for c in df.columns)).first()
            conditions = [c for c in texts if 0 < sizes[c] <= MOST_CONDITIONS]
            found = conditional_candidates(df, conditions, [c for c in df.columns if nullable[c]] or None) if any(nullable) and conditions else None
            if found is not None:
                keep = found.where((F.col("confidence") >= ACCEPTED) & (F.col("lift") >= LIFT)).orderBy("condition_field", "condition_value", "required_field")
                for r in keep.collect():
                    out.append(
                        Constraint(
                            "conditional_required", name, condition_field=r["condition_field"], condition_value=r["condition_value"],
                            required_field=r["required_field"], confidence=r["confidence"],
                        )
                    )
    return out + aggregate_candidates({n: df.columns for n, df in tables.items()})


def anonymise_conditions(constraints: list[Constraint], labels: dict[tuple[str, str], dict[str, str]]) -> list[Constraint]:
    """Condition values under the rank labels of their categories; what has no label goes."""
    out = []
    for c in constraints:
        if c.kind == "conditional_required":
            known = labels.get((c.entity, c.condition_field), {})
            if c.condition_value not in known:
                continue
            c = Constraint(**{**c.__dict__, "condition_value": known[c.condition_value]})
        out.append(c)
    return out

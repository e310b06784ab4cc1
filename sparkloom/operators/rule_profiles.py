"""How well a rule holds in a table: checked, passed, failed, confidence, status.

Each is one aggregation.  Rows whose fields are null are not checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import formula
from sparkloom.operators.constraints import present
from sparkloom.operators.profile import q
from sparkloom.operators.relationships import coverage

INFERRED = 0.9


def _report(counts: DataFrame, *extra: str) -> DataFrame:
    confidence = F.when(F.col("checked") == 0, F.lit(0.0)).otherwise(F.round(F.col("passed") / F.col("checked"), 6))
    return (
        counts.withColumn("failed", F.col("checked") - F.col("passed"))
        .withColumn("confidence", confidence)
        .select("checked", "passed", "failed", *extra, "confidence", F.when(F.col("confidence") >= INFERRED, "inferred").otherwise("rejected").alias("status"))
    )


def _count(df: DataFrame, checked: Column, passed: Column, *more: Column) -> DataFrame:
    return df.agg(F.count_if(checked).alias("checked"), F.count_if(checked & passed).alias("passed"), *more)


def foreign_key(parent: DataFrame, parent_field: str, child: DataFrame, child_field: str) -> DataFrame:
    return _report(coverage(child, child_field, parent, parent_field).withColumnRenamed("matched", "passed"))


def temporal_ordering(df: DataFrame, start: str, end: str, allow_equal: bool = True) -> DataFrame:
    s, e = q(start), q(end)
    return _report(_count(df, s.isNotNull() & e.isNotNull(), F.coalesce(s <= e if allow_equal else s < e, F.lit(False))))


def formula_rule(df: DataFrame, target: str, expression: str, tolerance: float = 1e-6) -> DataFrame:
    """Also avg_error and max_error over checked rows; rows that divide by zero aren't checked."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    f = formula.parse(expression)
    t, value = formula.number(target), f.column()
    checked = t.isNotNull() & value.isNotNull()
    for d in f.divisors():
        checked = checked & F.coalesce(d != 0, F.lit(False))
    error = F.when(checked, F.abs(t - value))
    counts = _count(df, checked, F.coalesce(error <= tolerance, F.lit(False)), F.avg(error).alias("avg_error"), F.max(error).alias("max_error"))
    return _report(counts, "avg_error", "max_error")


def conditional_required(df: DataFrame, condition_field: str, value, required_field: str) -> DataFrame:
    return _report(_count(df, F.coalesce(q(condition_field) == F.lit(value), F.lit(False)), present(q(required_field))))


def conditional_allowed_values(df: DataFrame, condition_field: str, value, field: str, allowed: list) -> DataFrame:
    """A null value fails."""
    if not 0 < len(allowed) <= 50:
        raise ValueError("between 1 and 50 values")
    return _report(_count(df, F.coalesce(q(condition_field) == F.lit(value), F.lit(False)), F.coalesce(q(field).isin(allowed), F.lit(False))))


def aggregated(child: DataFrame, key: str, value: str | None, how: str) -> DataFrame:
    """__key and __value by parent key; nulls in key are left out."""
    v = q(value).try_cast("double") if value else None
    expr = {"sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "count": lambda: (F.count(q(value)) if value else F.count("*")).cast("double")}[how]()
    return child.where(q(key).isNotNull()).groupBy(q(key).alias("__key")).agg(expr.alias("__value"))


def aggregate_mapping(
    parent: DataFrame, parent_key: str, parent_value: str, child: DataFrame, child_key: str, child_value: str | None, how: str = "sum", tolerance: float = 1e-6
) -> DataFrame:
    """Parents with a null value aren't checked; parents without children count as 0."""
    rows = parent.select(q(parent_key).alias("__parent"), q(parent_value).try_cast("double").alias("__want"))
    joined = rows.join(aggregated(child, child_key, child_value, how), F.col("__parent") == F.col("__key"), "left")
    error = F.abs(F.col("__want") - F.coalesce("__value", F.lit(0.0)))
    counts = _count(joined, F.col("__want").isNotNull(), F.coalesce(error <= tolerance, F.lit(False)), F.avg(error).alias("avg_error"), F.max(error).alias("max_error"))
    return _report(counts, "avg_error", "max_error")

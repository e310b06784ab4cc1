"""Restricted SELECT over one table, checked on Spark's own parsed plan before anything runs.

Two policies.  A query source is one SELECT of columns and named expressions from one
table with an optional WHERE; its result may be profiled.  A safe select also returns
rows, so it needs a LIMIT, allows no star and no sensitive column.

The walk covers the plan's nodes and every expression in them (subqueries, windows and
generators sit in expressions).  It uses the classic session's parser; Spark Connect
has none to offer.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import parse, privacy
from sparkloom.model import Dataset, Entity
from sparkloom.operators import profile
from sparkloom.operators.profile import q
from sparkloom.sources.budget import WorkBudget

POLICY_VERSION = "1"
MOST_NODES, MOST_DEPTH, MOST_ROWS, MOST_CHARS = 512, 32, 1000, 20_000
#: fixed values: what may stand in an expression
FUNCTIONS = {"abs", "coalesce", "lower", "round", "trim", "upper"}
EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedAlias", "Alias", "Literal", "Cast", "UnresolvedStar", "UnresolvedFunction",
    "Add", "Subtract", "Multiply", "Divide", "Remainder", "UnaryMinus", "UnaryPositive",
    "EqualTo", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Not", "And", "Or", "Between", "UnresolvedBetween",
    "In", "IsNull", "IsNotNull", "Like", "ILike", "StringTrim", "Lower", "Upper",
}
PLANS = {"Project", "Filter", "SubqueryAlias", "UnresolvedRelation"}


class QueryRefused(ValueError):
    """The query does not keep to the policy."""


@dataclass
class Checked:
    """A query that passed: its table, outputs and canonical text."""

    table: str
    outputs: list[str]
    sql: str
    limit: int | None = None
    columns: list[str] = field(default_factory=list)

    def fingerprint(self, adapter: str = "spark") -> str:
        return hashlib.sha256(json.dumps([POLICY_VERSION, adapter, self.sql]).encode()).hexdigest()


def _sequence(jvm_seq) -> list:
    return [jvm_seq.apply(i) for i in range(jvm_seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Walk:
    def __init__(self, limited: bool):
        self.nodes, self.limited = 0, limited
        self.tables: list[str] = []
        self.columns: list[str] = []
        self.limit: int | None = None
        self.star = False
        self.projects = 0

    def plan(self, node, depth: int = 0) -> None:
        name = _name(node)
        self._count(depth)
        if name in ("GlobalLimit", "LocalLimit") and self.limited:
            self.limit = int(node.limitExpr().value()) if _name(node.limitExpr()) == "Literal" else None
        elif name not in PLANS:
            raise QueryRefused(f"{name} is not allowed")
        elif name == "UnresolvedRelation":
            self.tables.append(".".join(_sequence(node.multipartIdentifier())))
        else:
            self.projects += name == "Project"
            for e in _sequence(node.expressions()):
                self.expression(e, depth + 1)
        for child in _sequence(node.children()):
            self.plan(child, depth + 1)

    def expression(self, node, depth: int) -> None:
        name = _name(node)
        self._count(depth)
        if name not in EXPRESSIONS:
            raise QueryRefused(f"{name} is not allowed")
        if name == "UnresolvedFunction":
            function = ".".join(_sequence(node.nameParts())).lower()
            if function not in FUNCTIONS and function not in ("like", "ilike", "between", "not", "%", "+", "-", "*", "/"):
                raise QueryRefused(f"function {function} is not allowed")
        elif name == "UnresolvedAttribute":
            self.columns.append(_sequence(node.nameParts())[-1])
        elif name == "UnresolvedStar":
            self.star = True
        for child in _sequence(node.children()):
            self.expression(child, depth + 1)

    def _count(self, depth: int) -> None:
        self.nodes += 1
        if self.nodes > MOST_NODES or depth > MOST_DEPTH:
            raise QueryRefused("the query is too large")


def _parsed(spark: SparkSession, sql: str):
    if len(sql) > MOST_CHARS:
        raise QueryRefused("the query is too long")
    if "--" in sql or "/*" in sql:
        raise QueryRefused("comments are not allowed")
    text = sql.strip().rstrip(";").strip()
    if ";" in text:
        raise QueryRefused("one statement only")
    try:
        return text, spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise QueryRefused("the query can't be parsed") from e


def _outputs(spark: SparkSession, plan_text: str, walk: _Walk, allowed: dict[str, set[str]] | None) -> tuple[str, list[str]]:
    if len(walk.tables) != 1:
        raise QueryRefused("exactly one table must be read")
    table = walk.tables[0]
    if walk.projects != 1:
        raise QueryRefused("exactly one SELECT is allowed")
    if allowed is not None:
        scope = allowed.get(table)
        if scope is None:
            raise QueryRefused(f"table {table} is not in scope")
        if "*" not in scope and (bad := {c for c in walk.columns if c not in scope}):
            raise QueryRefused(f"columns {sorted(bad)} are not in scope")
        if walk.star and "*" not in scope and set(spark.table(table).columns) - scope:
            raise QueryRefused("a star reaches beyond the scope")
    return table, walk.columns


def query_source(spark: SparkSession, sql: str, allowed: dict[str, set[str]] | None = None) -> tuple[Checked, DataFrame]:
    """A checked query and its (lazy) result; a lone star becomes the sorted columns."""
    text, plan = _parsed(spark, sql)
    walk = _Walk(False)
    walk.plan(plan)
    table, columns = _outputs(spark, text, walk, allowed)
    df = spark.sql(text)
    if walk.star:
        df = df.select(*(q(c) for c in sorted(df.columns)))
    if len(set(df.columns)) != len(df.columns):
        raise QueryRefused("output columns must have distinct names")
    for e, n in zip(df.schema, df.columns, strict=True):
        if not n.replace("_", "").isalnum():
            raise QueryRefused(f"expression {n} needs a name")
        parse.logical_type(e.dataType)
    return Checked(table, df.columns, " ".join(text.split()), None, columns), df


def safe_select(spark: SparkSession, sql: str, allowed: dict[str, set[str]] | None = None) -> DataFrame:
    """At most MOST_ROWS rows of columns that aren't sensitive."""
    text, plan = _parsed(spark, sql)
    walk = _Walk(True)
    walk.plan(plan)
    _outputs(spark, text, walk, allowed)
    if walk.star:
        raise QueryRefused("columns must be named")
    if walk.limit is None or not 1 <= walk.limit <= MOST_ROWS:
        raise QueryRefused(f"a LIMIT from 1 to {MOST_ROWS} is needed")
    if bad := sorted({c for c in walk.columns if privacy.sensitive_name(c)}):
        raise QueryRefused(f"columns {bad} are sensitive")
    return spark.sql(text)


def mask_rows(df: DataFrame) -> DataFrame:
    """Values of sensitive columns masked, nested ones too."""
    return df.select(*(privacy.mask_nested(q(f.name), f.dataType, name=f.name).alias(f.name) for f in df.schema))


def profile_query(spark: SparkSession, sql: str, allowed: dict[str, set[str]] | None = None, keep_values: tuple[str, ...] = (), budget: WorkBudget | None = None) -> Dataset:
    """Profile of a query's result without bounds or values of its own: numbers get a shape only."""
    budget = budget or WorkBudget({})
    budget.charge(sql_chars=len(sql))
    checked, df = query_source(spark, sql, allowed)
    name = checked.table.split(".")[-1]
    budget.charge(profiled_columns=len(df.columns))
    budget.charge_scan(df)
    with budget.running(spark):
        return _profiled(df, name, checked, keep_values)


def _profiled(df: DataFrame, name: str, checked: Checked, keep_values: tuple[str, ...]) -> Dataset:
    held: Entity = profile.profile(df, name, keep_values)
    shapes = {f.name for f in held.fields if (f.distribution or {}).get("kind") == "numeric"}
    if shapes:
        rows = {r["column_name"]: r for r in profile.numeric_shape(df, sorted(shapes)).collect()}
        for f in held.fields:
            if f.name in shapes:
                f.distribution = {"kind": "numeric_shape", **{k: rows[f.name][k] for k in ("max_abs_magnitude", "has_negative", "has_positive")}}
    return Dataset([held], name=checked.fingerprint())


def query_summary(df: DataFrame) -> DataFrame:
    """column_name, row_count, non_null, distinct_count of every column of a result."""
    wide = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        wide += [F.count(q(c)).alias(f"c{i}"), F.count_distinct(q(c)).alias(f"d{i}")]
    parts = {c: [("row_count", F.col("n")), ("non_null", F.col(f"c{i}")), ("distinct_count", F.col(f"d{i}"))] for i, c in enumerate(df.columns)}
    return profile.melted(df.agg(*wide), parts)

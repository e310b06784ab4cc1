"""PostgreSQL and Trino through JDBC: read-only sessions, budgets, catalogs with their keys.

The driver's jar is the caller's.  Catalog queries are standard ``information_schema``
text, so that any database that has it can answer them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.model import SpecError
from sparkloom.sources.budget import POSTGRES, WorkBudget
from sparkloom.sources.catalog import Keys
from sparkloom.sources.readers import jdbc


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def tables_sql(schema: str) -> str:
    return f"SELECT table_name FROM information_schema.tables WHERE table_schema = {text(schema)} ORDER BY table_name"


def columns_sql(schema: str, tables: list[str]) -> str:
    """Columns of some tables, or of all (``*``), by place."""
    scope = "" if "*" in tables else f" AND table_name IN ({', '.join(map(text, tables))})"
    return (
        "SELECT table_name, column_name, data_type, is_nullable, ordinal_position FROM information_schema.columns "
        f"WHERE table_schema = {text(schema)}{scope} ORDER BY table_name, ordinal_position"
    )


def primary_keys_sql(schema: str) -> str:
    return (
        "SELECT k.table_name, k.column_name, k.ordinal_position FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
        "ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name "
        f"WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = {text(schema)} ORDER BY k.table_name, k.ordinal_position"
    )


def foreign_keys_sql(schema: str) -> str:
    return (
        "SELECT k.table_name AS child, k.column_name AS child_field, p.table_name AS parent, p.column_name AS parent_field, k.constraint_name, k.ordinal_position "
        "FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_schema = r.constraint_schema AND k.constraint_name = r.constraint_name "
        "JOIN information_schema.key_column_usage p ON p.constraint_schema = r.unique_constraint_schema AND p.constraint_name = r.unique_constraint_name AND p.ordinal_position = k.position_in_unique_constraint "
        f"WHERE k.table_schema = {text(schema)} ORDER BY child, k.constraint_name, k.ordinal_position"
    )


def checks_sql(schema: str) -> str:
    return (
        "SELECT c.table_name, h.constraint_name, h.check_clause FROM information_schema.check_constraints h JOIN information_schema.table_constraints c "
        f"ON c.constraint_schema = h.constraint_schema AND c.constraint_name = h.constraint_name WHERE c.table_schema = {text(schema)} ORDER BY c.table_name, h.constraint_name"
    )


def keys_of(primary: list, foreign: list) -> Keys:
    """Declared keys of one column each; keys of several columns are left out."""
    wide = {r[0] for r in primary if r[2] > 1}
    several = {(r[0], r[4]) for r in foreign if r[5] > 1}
    return Keys({r[0]: r[1] for r in primary if r[0] not in wide}, [(r[0], r[1], r[2], r[3]) for r in foreign if (r[0], r[4]) not in several])


class Database:
    """A read-only source with a budget."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, budget: WorkBudget | None = None):
        self.spark, self.url, self.properties = spark, url, dict(properties or {})
        self.budget = budget or WorkBudget(POSTGRES)

    def session(self) -> dict[str, str]:
        """Options of a session: no writes, and no statement beyond the deadline."""
        left = self.budget.left()
        options = {} if left is None else {"queryTimeout": str(max(1, int(left)))}
        if self.url.startswith("jdbc:postgresql:"):
            timeout = "" if left is None else f" SET statement_timeout = {max(1, int(left * 1000))};"
            options["sessionInitStatement"] = f"SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY;{timeout}"
        elif self.url.startswith("jdbc:trino:") and left is not None:
            options["sessionInitStatement"] = f"SET SESSION query_max_run_time = '{max(1, int(left))}s'"
        return options

    def query(self, sql: str, partition: dict | None = None) -> DataFrame:
        """A statement's result as a table; rows are read where the tasks are."""
        if ";" in sql or not sql.lstrip().lower().startswith("select"):
            raise SpecError("one SELECT only")
        self.budget.charge(statements=1, sql_chars=len(sql))
        return jdbc(self.spark, self.url, sql, self.properties | self.session(), partition)

    def rows(self, sql: str) -> list:
        return self.budget.rows(self.query(sql))

    def tables(self, schema: str) -> list[str]:
        found = [r[0] for r in self.rows(tables_sql(schema).split(" ORDER BY")[0])]
        self.budget.charge(tables=len(found))
        return sorted(found)

    def keys(self, schema: str) -> Keys:
        plain = lambda sql: self.rows(sql.rsplit(" ORDER BY", 1)[0])  # noqa: E731 (a JDBC source is a subquery, whose order means nothing)
        return keys_of(plain(primary_keys_sql(schema)), plain(foreign_keys_sql(schema)))

    def checks(self, schema: str) -> list[tuple[str, str, str]]:
        return sorted(tuple(r) for r in self.rows(checks_sql(schema).rsplit(" ORDER BY", 1)[0]))

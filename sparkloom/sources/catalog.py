"""Catalog listings, allowlists and declared keys.

Spark enforces no keys, so primary and foreign keys (as a database's own catalog would
list them) are declared by the caller and measured against the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions import parse
from sparkloom.model import Relationship, SpecError
from sparkloom.operators.profile import q
from sparkloom.operators.relationships import coverage
from sparkloom.operators.validate import duplicate_keys

MOST_ROWS = 1000


def allowed_columns(table: str, columns: list[str], allowed: set[str]) -> list[str]:
    """The sorted columns of a table within an allowlist of ``table.column`` and ``table.*``."""
    if f"{table}.*" in allowed:
        return sorted(columns)
    wanted = {a.split(".", 1)[1] for a in allowed if a.split(".", 1)[0] == table and "." in a}
    if missing := wanted - set(columns):
        raise SpecError(f"{table} has no columns {sorted(missing)}")
    return sorted(wanted)


def project(df: DataFrame, table: str, allowed: set[str]) -> DataFrame:
    names = allowed_columns(table, df.columns, allowed)
    if not names:
        raise SpecError(f"{table} is not in scope")
    return df.select(*(q(n) for n in names))


def limited(df: DataFrame, n: int) -> DataFrame:
    """At most n rows, and at most MOST_ROWS."""
    return df.limit(max(1, min(n, MOST_ROWS)))


def catalogs(spark: SparkSession, allowed: set[str] | None = None) -> list[str]:
    return sorted(c.name for c in spark.catalog.listCatalogs() if allowed is None or c.name in allowed)


def schemas(spark: SparkSession, allowed: set[str] | None = None) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if allowed is None or d.name in allowed)


def tables(spark: SparkSession, schema: str | None = None, allowed: set[str] | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(schema) if allowed is None or t.name in allowed)


def describe(spark: SparkSession, table: str) -> list[dict[str, str | bool]]:
    """Columns by position; only scalar ones have a logical type."""
    out = []
    for f in spark.table(table).schema:
        try:
            kind = parse.logical_type(f.dataType)
        except TypeError:
            kind = "unsupported"
        out.append({"column": f.name, "type": f.dataType.simpleString(), "logical_type": kind, "nullable": f.nullable})
    return out


@dataclass
class Keys:
    """Declared keys: primary[table] = column; foreign = (child, column, parent, column)."""

    primary: dict[str, str] = field(default_factory=dict)
    foreign: list[tuple[str, str, str, str]] = field(default_factory=list)

    def relationships(self, held: dict[str, DataFrame]) -> list[Relationship]:
        """Declared relationships with their measured coverage; unique child keys make them one to one."""
        out = []
        for child, ck, parent, pk in self.foreign:
            got = coverage(held[child], ck, held[parent], pk).first()
            share = round(got["matched"] / got["checked"], 6) if got["checked"] else 0.0
            unique = duplicate_keys(held[child], ck).first()["n"] == 0
            out.append(Relationship(parent, pk, child, ck, "one_to_one" if unique else "many_to_one", "declared", share))
        return out

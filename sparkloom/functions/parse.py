"""Text parsing guards as Column expressions.

A CSV cell is text; these decide which logical type it reads as.  Spark's own casts
accept another language (``2024-1-1``, ``1.5f``), so each parser is a pattern guard
followed by a ``try_`` cast.  Blank text counts as null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: canonical integers: what prints back as it was read
INTEGER = r"^(0|-?[1-9][0-9]*)$"
FLOAT = r"(?i)^[+-]?(([0-9](_?[0-9])*)(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"
TRUE = ("true", "t", "1", "yes", "y")
FALSE = ("false", "f", "0", "no", "n")
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2}(:?[0-9]{2})?)?$"


def cell(c: Column) -> Column:
    """Text of a cell without surrounding blanks; blank is null."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(" \t\r\n")), F.lit(""))


def integer(c: Column) -> Column:
    c = cell(c)
    return F.when(c.rlike(INTEGER), c.try_cast("decimal(38,0)"))


def floating(c: Column) -> Column:
    c = cell(c)
    plain = F.when(c.rlike(FLOAT), F.regexp_replace(c, "_", "").try_cast("double"))
    lower = F.lower(c)
    value = F.when(lower.endswith("nan"), F.lit(float("nan"))).when(lower.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    special = F.when(c.rlike(NOT_FINITE), value)
    return F.coalesce(plain, special)


def boolean(c: Column) -> Column:
    c = F.lower(cell(c))
    return F.when(c.isin(*TRUE), F.lit(True)).when(c.isin(*FALSE), F.lit(False))


def date(c: Column) -> Column:
    """The first ten characters as an ISO date; what follows doesn't matter."""
    c = cell(c)
    return F.when(c.rlike(DATE), F.substring(c, 1, 10).try_cast("date"))


def timestamp(c: Column) -> Column:
    c = cell(c)
    full = F.when(F.length(c) == 13, F.concat(c, F.lit(":00"))).otherwise(F.regexp_replace(c, ",", "."))
    return F.when(c.rlike(DATETIME), full.try_cast("timestamp"))


PARSERS = {"integer": integer, "float": floating, "boolean": boolean, "datetime": timestamp, "date": date}
#: the first type all cells read as is the column's
PRIORITY = ("integer", "float", "boolean", "datetime", "date")
SPARK_TYPE = {"integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp", "date": "date", "string": "string"}


def typed(c: Column, kind: str) -> Column:
    """A text cell as its logical type."""
    return PARSERS[kind](c).cast(SPARK_TYPE[kind]) if kind in PARSERS else cell(c)


def logical_type(data_type) -> str:
    """Logical type of a Spark type; nested and interval types are refused."""
    name = data_type.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if name in ("float", "double") or name.startswith("decimal"):
        return "float"
    if name in ("boolean", "date"):
        return name
    if name in ("timestamp", "timestamp_ntz"):
        return "datetime"
    if name == "string" or name.startswith(("varchar", "char")):
        return "string"
    raise TypeError(f"column type {name} is not scalar")

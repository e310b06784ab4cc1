"""Random draws that depend on nothing but their key.

A draw is a hash of (seed, entity, field, draw, row), so it is the same whatever the
partitions are and after any retry.  md5 backs draws that another engine must be able
to repeat; xxhash64 is several times faster and backs bulk generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW = "__row_idx"


def uniform(seed: int, entity: str, field: str, draw: str, row: Column | None = None, fast: bool = False) -> Column:
    """In [0, 1), with 32 bits (md5) or 53 bits (fast)."""
    row = F.col(ROW) if row is None else row
    if fast:
        return F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}|{entity}|{field}|{draw}"), row), 11).cast("double") / float(1 << 53)
    text = F.concat(F.lit(f"{seed}|{entity}|{field}|{draw}|"), row.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def whole(u: Column, low, high) -> Column:
    """A whole number from low to high, both included."""
    low, high = F.lit(low), F.lit(high)
    return (low + F.floor(u * (high - low + 1))).cast("bigint")


def weighted(u: Column, values: list, weights: list[float]) -> Column:
    """The first value whose cumulative weight reaches u * total."""
    total, reach, out = float(sum(weights)), 0.0, None
    for value, weight in zip(values, weights, strict=True):
        reach += weight
        test = u * total <= reach
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(values[-1]))


def letters(seed: int, entity: str, field: str, length: Column, fast: bool = False) -> Column:
    """Lower-case letters, each from a draw of its own."""
    def one(i: Column) -> Column:
        key = F.concat(F.lit(f"{seed}|{entity}|{field}|letter|"), F.col(ROW).cast("string"), F.lit("|"), i.cast("string"))
        code = F.pmod(F.xxhash64(key), F.lit(26)) if fast else F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 26
        return F.char((code + 97).cast("int"))

    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(1), length), one), "")).otherwise(F.lit(""))

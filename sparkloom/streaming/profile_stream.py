"""Profiles of streams: windowed counts and merged measures.

``windowed`` is an ordinary watermarked aggregation.  ``running_profile`` folds every
micro-batch into one row of mergeable measures for each column (counts, bounds and
HyperLogLog sketches) kept as a table by batch, so a replayed batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.profile import melted, q


def windowed(events: DataFrame, time: str, value: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts, non-null counts, bounds and shape of a value by window and keys."""
    c = q(value).cast("double")
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(q(time), width).alias("window"), *(q(k) for k in keys))
        .agg(F.count("*").alias("row_count"), F.count(c).alias("non_null"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.coalesce(F.bool_or(c < 0), F.lit(False)).alias("has_negative"))
        .select(F.col("window.start").alias("window_start"), *(q(k) for k in keys), "row_count", "non_null", "min_value", "max_value", "has_negative")
    )


def measured(c: Column, data_type: T.DataType) -> tuple[str, Column]:
    """What bounds are kept of a column, and in which unit: numbers, seconds since 1970, or the length of anything else."""
    if isinstance(data_type, T.NumericType):
        return "number", c.cast("double")
    if isinstance(data_type, T.BooleanType):
        return "number", c.cast("int").cast("double")
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "seconds", c.cast("timestamp").cast("double")
    return "length", F.length(c.cast("string")).cast("double")


def measures(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, unit, row_count, non_null, low, high, sketch: partial profiles that merge."""
    wide, parts = [F.count("*").alias("n")], {}
    for i, name in enumerate(columns):
        unit, value = measured(q(name), df.schema[name].dataType)
        wide += [F.count(q(name)).alias(f"c{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.hll_sketch_agg(q(name).cast("string")).alias(f"s{i}")]
        parts[name] = [("unit", F.lit(unit)), ("row_count", F.col("n")), ("non_null", F.col(f"c{i}")), ("low", F.col(f"lo{i}")), ("high", F.col(f"hi{i}")), ("sketch", F.col(f"s{i}"))]
    return melted(df.agg(*wide), parts)


def merged(parts: DataFrame) -> DataFrame:
    """Partial profiles of any number of batches as one."""
    return parts.groupBy("column_name", "unit").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("non_null").alias("non_null"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"),
    )


def running_profile(stream: DataFrame, columns: list[str], store: str, checkpoint: str):
    """Starts a query that keeps ``store/batch=<n>`` with each batch's measures."""

    def fold(batch: DataFrame, number: int) -> None:
        measures(batch, columns).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Places and running values within groups of any size.

A window over a group puts the group in one task.  Here rows are range-partitioned by
(key, order), numbered within their partition, and what a group had in the partitions
before is added from one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written


class _State:
    """What the last group of the rows seen so far holds."""

    def __init__(self):
        self.key, self.count, self.last = None, 0, None

    def batch(self, key: np.ndarray, value: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each row in its group, and the last value before it (with whether there is one)."""
        n = len(key)
        at = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(new, at, 0))
        first = int(np.argmax(new[1:])) + 1 if new[1:].any() else n
        goes_on = self.key is not None and key[0] == self.key
        place = at - begin + 1
        seen = np.maximum.accumulate(np.where(valid, at, -1))
        before = np.r_[-1, seen[:-1]]
        has = before >= begin
        last = np.where(has, value[np.maximum(before, 0)], 0)
        if goes_on:
            place[:first] += self.count
            if self.last is not None:
                open_ = np.arange(first)[~has[:first]]
                last[open_], has[open_] = self.last, True
        end_has = bool(valid[-1] or has[-1])
        self.key, self.count, self.last = key[-1], int(place[-1]), int(value[-1] if valid[-1] else last[-1]) if end_has else None
        return place, last, has


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, state, first = TaskContext.get().partitionId(), _State(), None
    empty = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("last", pa.int64()), ("ends", pa.bool_()), ("end_last", pa.int64())])

    def row(i, k, place, last, has, ends, end_last):
        return pa.RecordBatch.from_arrays(
            [i, pa.array(k), pa.array(np.full(len(k), part, np.int32)), pa.array(place), pa.array(last, mask=~has), pa.array(ends), end_last], schema=empty
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(1).to_numpy()
        first = key[0] if first is None else first
        values = batch.column(2)
        valid = np.asarray(values.is_valid())
        place, last, has = state.batch(key, values.fill_null(0).to_numpy(zero_copy_only=False), valid)
        yield row(batch.column(0), key, place, last, has, np.zeros(len(key), bool), pa.nulls(len(key), pa.int64()))
    if first is not None:  # what goes on in the next partition
        whole = pa.array([int(first == state.key)], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [whole, pa.array([state.key]), pa.array([part], pa.int32()), pa.array([state.count]), pa.array([state.last], pa.int64()), pa.array([True]), pa.array([int(first)], pa.int64())], schema=empty
        )


def numbered(rows: DataFrame, key: list[str], order: list, value: str | None = None) -> DataFrame:
    """id (kept), place (from 1) and last: the last non-null value strictly before each row of its group.

    rows: a column ``id``, the key's and order's columns and a bigint value.  Nulls of a
    key are a group like any other.
    """
    spark = rows.sparkSession
    mark = F.xxhash64(*(x for k in key for x in (F.col(k), F.col(k).isNull())))
    dealt = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    dealt = dealt.select("id", mark.alias("key"), (F.col(value) if value else F.lit(None)).cast("bigint").alias("value"))
    out = written(dealt.mapInArrow(_number, "id bigint, key bigint, part int, place bigint, last bigint, ends boolean, end_last bigint"), "numbered")
    # one row for each partition: its last group, that group's rows and last value, and whether it began there
    carried, count, last, held = [], 0, None, None
    for r in sorted(out.where("ends").collect(), key=lambda r: r["part"]):
        if held == r["end_last"]:
            carried.append((r["part"], held, count, last))
        goes_on = bool(r["id"]) and held == r["key"]
        count = r["place"] + (count if goes_on else 0)
        last = r["last"] if r["last"] is not None else last if goes_on else None
        held = r["key"]
    before = spark.createDataFrame(carried, "part int, key bigint, more bigint, earlier bigint")
    placed = out.where("NOT ends").join(F.broadcast(before), ["part", "key"], "left")
    return placed.select("id", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("last", "earlier").alias("last"))

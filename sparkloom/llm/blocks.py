"""Exchange of fixed-width entries between tasks as packed binary blocks.

A signature join ships an entry for every few words of the corpus.  As Spark rows
each would cost an object and a sort step in the JVM; packed by bucket into one
binary per map batch and bucket they move as plain bytes, and a reducer sorts each
bucket with numpy.  The shuffle is an ordinary ``repartition`` on the bucket, so
lost executors, spilling and fetch failures are Spark's own business.  The number
of buckets follows the input, so a bucket's size doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "bucket int, payload binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def input_bytes(df: DataFrame) -> int:
    """What the optimiser knows of the size of df (for files, their bytes), or else the bytes of its texts, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    return int(sum(df.agg(F.count("*"), *texts).first()))


def bucket_count(df: DataFrame, each: int = 2 << 20, least: int = 32) -> int:
    """Buckets so that each gets the entries of about ``each`` bytes of input."""
    return int(max(least, math.ceil(input_bytes(df) / each)))


def partition_count(df: DataFrame, each: int = 64 << 20) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(df) / each))


def pack(bucket: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket; entries is a structured array."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket, entries = bucket[order], np.ascontiguousarray(entries[order])
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(bucket)].astype(np.int64) if len(at) else at
    raw = entries.view(np.uint8).reshape(-1) if len(entries) else np.zeros(0, np.uint8)
    width = entries.dtype.itemsize
    offsets = np.r_[0, ends * width].astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), payload], schema=_ARROW)


def exchange(blocks: DataFrame, partitions: int) -> DataFrame:
    """Bring the blocks of a bucket together, bucket after bucket.

    Where the session's own number of shuffle partitions suffices it is used, so that
    adaptive execution may join small ones.
    """
    if partitions <= int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return blocks.repartition("bucket").sortWithinPartitions("bucket")
    return blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket")


def buckets(batches: Iterable[pa.RecordBatch], dtype: np.dtype | dict[int, np.dtype]) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each bucket from sorted blocks.

    With several kinds of entries, dtype is by the bucket's number modulo 4; kinds but 0
    pass through, so their blocks are handed on one by one.
    """
    current, held = None, []
    of = lambda b: dtype[b % 4] if isinstance(dtype, dict) else dtype
    for batch in batches:
        ids = batch.column(0).to_numpy()
        payload = batch.column(1)
        for i, b in enumerate(ids):
            if b != current and held:
                yield int(current), np.frombuffer(b"".join(held), of(current))
                held = []
            current = b
            held.append(payload[i].as_py())
            if isinstance(dtype, dict) and b % 4:
                yield int(b), np.frombuffer(held.pop(), of(b))
    if held:
        yield int(current), np.frombuffer(b"".join(held), of(current))


def reduce_blocks(
    blocks: DataFrame, partitions: int, dtype: np.dtype | dict[int, np.dtype], reducer: Callable[[int, np.ndarray], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, entries in buckets(batches, dtype):
            yield from reducer(bucket, entries)

    return exchange(blocks, partitions).mapInArrow(run, schema)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a mixed 64-bit key, from its high bits."""
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)

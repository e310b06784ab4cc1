"""Removal spans gathered by document: shared by the two passage deduplicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks
from sparkloom.llm.kernels import group_starts, mix64

NULL_ID = -(1 << 63)
SPAN = np.dtype([("doc", "<i8"), ("text", "<u8"), ("start", "<u4"), ("end", "<u4")])
SPAN_SCHEMA = "doc_id bigint, text_hash bigint, start long, end long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null as the least number), text and a hash of the text.

    The hash tells rows apart that share a doc_id; rows alike in both are one document.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash")
    )


def doc_bucket(doc: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return blocks.bucket_of(mix64(doc.astype(np.int64).view(np.uint64) ^ text), n)


def merged(entries: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document as one."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["end"], entries["start"], entries["text"], entries["doc"]))]
    own = np.zeros(len(entries), np.int64)
    own[group_starts(entries["doc"], entries["text"])] = 1
    group = np.cumsum(own) - 1
    # running maximum of the end within a document: lift each document above all before it
    lift = group << 33
    reach = np.maximum.accumulate(entries["end"].astype(np.int64) + lift)
    new = np.ones(len(entries), bool)
    new[1:] = (group[1:] != group[:-1]) | (entries["start"][1:].astype(np.int64) + lift[1:] > reach[:-1])
    at = np.flatnonzero(new)
    out = entries[at].copy()
    last = np.r_[at[1:], len(entries)] - 1
    out["end"] = (reach[last] - lift[last]).astype(np.uint32)
    return out


class Firsts:
    """Keys that a task has met more than once, each with the first place it has met.

    What comes after a place that went to the key's bucket already needn't go there too,
    so that a hot passage reaches its bucket a few times for each task, not once for
    each slice.  Only keys repeated within a slice are kept, MOST of them.
    """

    MOST = 1 << 16
    HELD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<u8"), ("place", "<u4")])

    def __init__(self):
        self.held = np.empty(0, self.HELD)

    def later(self, key: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Of one place for each (distinct) key: whether a known place comes before it.  ``repeated`` keys are kept."""
        new = np.empty(len(key), self.HELD)
        new["key"], new["doc"], new["text"], new["place"] = key, doc, text, place
        out = np.zeros(len(new), bool)
        if len(self.held) and len(new):
            at = np.minimum(np.searchsorted(self.held["key"], key), len(self.held) - 1)
            met = self.held["key"][at] == key
            old = self.held[at]
            before = (old["doc"] < doc) | (old["doc"] == doc) & ((old["text"] < text) | (old["text"] == text) & (old["place"] < place))
            out = met & before
            self.held[at[met & ~before]] = new[met & ~before]
            repeated = repeated & ~met
        free = self.MOST - len(self.held)
        if free > 0 and repeated.any():
            both = np.concatenate([self.held, new[np.flatnonzero(repeated)[:free]]])
            self.held = both[np.argsort(both["key"], kind="stable")]
        return out


def gathered(span_blocks: DataFrame, partitions: int) -> DataFrame:
    """One row for each merged span."""

    def reducer(_: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = merged(entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc"]), pa.array(np.ascontiguousarray(out["text"]).view(np.int64)), pa.array(out["start"].astype(np.int64)), pa.array(out["end"].astype(np.int64))],
            names=["doc_id", "text_hash", "start", "end"],
        )

    return blocks.reduce_blocks(span_blocks, partitions, SPAN, reducer, SPAN_SCHEMA)

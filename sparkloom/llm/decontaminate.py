"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of about 4 MB of documents.  Its words become numbers in the
benchmark's vocabulary.  A word outside it can't be part of a test phrase, so the
shard is cut there and stretches shorter than the shortest phrase are left out; what
remains is indexed (suffix array, Burrows-Wheeler transform in a wavelet matrix,
every eighth place sampled).  All test phrases are searched backward at once, their
occurrences located and merged into removal spans.

A phrase is ``window`` consecutive words of an item, or all of a shorter one.  Words
are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Scale: one map pass over the documents, no shuffle, as long as the benchmark fits in
one block of about ``block_bytes`` of text (it goes to the tasks with the closure).  A
larger one is searched block after block: the driver and each task hold one block at a
time, each pass writes the rows it hits, and these few rows are merged and joined back.

Defined results: null and empty texts have no words and no hits; null or empty items
have no phrase; an item_id that is null joins as an empty string; items that share an
id count once; repeated rows each get their row; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh, written
from sparkloom.llm.fm_index import FMIndex
from sparkloom.llm.kernels import ALNUM, Words, group_starts, ranges, runs_at, slices, string_buffers
from sparkloom.llm.spans import NULL_ID, keyed

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Phrases searched at a time.
SEARCHED = 1 << 16
RESULT = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "spans array<struct<start:bigint,end:bigint>>"
)
_HITS = np.dtype([("start", "<u4"), ("end", "<u4")])


class Phrases:
    """The distinct phrases of a block of items, as numbers in the block's vocabulary.

    Held are the items' words as one sequence and where in it each phrase begins, so that
    a block takes a few bytes for each word, not for each word of each phrase.
    """

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        raw, offsets = string_buffers(pa.array(texts, pa.string()))
        words = Words(raw, offsets, 0, len(texts), ALNUM)
        self.ids = ids
        self.vocabulary = np.unique(words.hash)
        self.sequence = (np.searchsorted(self.vocabulary, words.hash) + 1).astype(np.int32)
        self.groups = []
        size = np.minimum(words.count, window)
        for n in np.unique(size[size > 0]):
            own = np.flatnonzero(size == n)
            count = words.count[own] - n + 1
            at, item = ranges(words.begin[own], count), np.repeat(own, count)
            key = runs_at(words.hash, at, int(n), 61)
            order = np.lexsort((item, key))
            begin = group_starts(key[order])
            self.groups.append((int(n), at[order][begin].astype(np.int32), item[order].astype(np.int32), np.r_[begin, len(order)]))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and item of each occurrence in a shard."""
        none = np.zeros(0, np.int64)
        if not self.groups or not len(words.hash):
            return none, none, none
        at = np.searchsorted(self.vocabulary, words.hash)
        at[at == len(self.vocabulary)] = 0
        number = np.where(self.vocabulary[at] == words.hash, at + 1, 0)
        # stretches of known words within a row
        row = words.row()
        known = number > 0
        new = np.ones(len(number), bool)
        new[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.r_[begin, len(number)])
        keep = known[begin] & (length >= self.shortest)
        begin, length = begin[keep], length[keep]
        if not len(begin):
            return none, none, none
        where = ranges(begin, length + 1)
        tail = np.cumsum(length + 1) - 1
        seq = number[np.minimum(where, len(number) - 1)]
        seq[tail] = 0
        index = FMIndex(seq, len(self.vocabulary) + 1)
        found = []
        for size, at, item, first in self.groups:
            for part in range(0, len(at), SEARCHED):
                table = self.sequence[at[part : part + SEARCHED, None] + np.arange(size)]
                lo, hi = index.search(table)
                hit = np.flatnonzero(hi > lo)
                count = hi[hit] - lo[hit]
                place = where[index.locate(ranges(lo[hit], count))]
                which = part + np.repeat(hit, count)
                many = first[which + 1] - first[which]
                found.append((np.repeat(place, many), np.full(int(many.sum()), size), item[ranges(first[which], many)]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted spans without overlap."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    out = np.empty(len(at), _HITS)
    out["start"] = start[at]
    out["end"] = end[np.r_[at[1:], len(start)] - 1] if len(at) else end
    return out


def _found(phrases: Phrases, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, list[str]]]]:
    """Words of each row of a batch; and of each row that is hit its spans and items."""
    count, out = np.zeros(len(offsets) - 1, np.int64), {}
    for lo, hi in slices(offsets):
        words = Words(raw, offsets, lo, hi, ALNUM)
        count[lo:hi] = words.count
        start, size, item = phrases.occurrences(words)
        if not len(start):
            continue
        row = np.searchsorted(words.begin, start, side="right") - 1
        start = start - words.begin[row]
        order = np.argsort(row, kind="stable")
        row, start, end, item = row[order], start[order], (start + size)[order], item[order]
        at = group_starts(row)
        for a, b in zip(at, np.r_[at[1:], len(row)], strict=True):
            out[lo + int(row[a])] = _union(start[a:b], end[a:b]), sorted({phrases.ids[i] for i in np.unique(item[a:b])})
    return count, out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _reported(ids, count, found: dict) -> pa.RecordBatch:
    """RESULT rows."""
    n_hit, n_items, digests, bad, spans = [], [], [], [], []
    nothing, none = np.empty(0, _HITS), hashlib.sha256(b"").hexdigest()
    for i, n in enumerate(count):
        own, items = found.get(i, (nothing, []))
        hit = int((own["end"].astype(np.int64) - own["start"]).sum())
        n_hit.append(hit)
        n_items.append(len(items))
        digests.append(hashlib.sha256(",".join(items).encode()).hexdigest() if items else none)
        bad.append(hit > 0 and 20 * hit >= n)
        spans.append([{"start": int(a), "end": int(b)} for a, b in own.tolist()])
    columns = [pa.array(count), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_()), pa.array(spans, _SPANS)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


def _report(phrases: Phrases):
    """RESULT of each row (doc_id, text), for a benchmark of one block."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _reported(batch.column(0), *_found(phrases, *string_buffers(batch.column(1))))

    return kernel


HIT = "doc_id bigint, text_hash bigint, hits binary, items array<string>"


def _hit_rows(phrases: Phrases):
    """HIT of the rows (doc_id, text, text_hash) that a block hits."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = _found(phrases, *string_buffers(batch.column(1)))
            at = pa.array(list(found), pa.int64())
            hits, items = [found[i][0].tobytes() for i in found], [found[i][1] for i in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text_hash", "hits", "items"]
            )

    return kernel


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = string_buffers(batch.column(1))
        count = [Words(raw, offsets, lo, hi, ALNUM).count for lo, hi in slices(offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(count) if count else np.zeros(0, np.int64))], names=["doc_id", "text_hash", "n_words"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT of rows (doc_id, n_words, hits of each block, items of each block)."""
    for batch in batches:
        found = {}
        for i, (hits, items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if hits:
                own = np.frombuffer(b"".join(hits), _HITS)
                found[i] = _union(own["start"].astype(np.int64), own["end"].astype(np.int64)), sorted({x for part in items for x in part})
        yield _reported(batch.column(0), batch.column(1).to_numpy(), found)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """The items, at most about block_bytes of text at a time; the driver holds one block (and one partition that Spark reads)."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    for row in rows.toLocalIterator():
        ids.append(row["item"])
        texts.append(row["text"])
        size += len(row["text"] or "")
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _hits_by_block(keyed: DataFrame, blocks: Iterator[tuple[list[str], list[str | None]]], window: int) -> DataFrame:
    """HIT of every row (doc_id, text, text_hash) and block, one pass a block; repeated rows count once."""
    found = [written(keyed.mapInArrow(_hit_rows(Phrases(ids, texts, window)), HIT), "hits") for ids, texts in blocks]
    return reduce(DataFrame.union, found).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: counts, items, contaminated, and the removal spans in words."""
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_report(Phrases(*first, window)), RESULT)
    rows = keyed(docs).select("doc_id", "text", "text_hash")
    found = _hits_by_block(rows, chain([first, second], blocks), window).groupBy("doc_id", "text_hash").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    counted = rows.mapInArrow(_count_words, "doc_id bigint, text_hash bigint, n_words bigint")
    joined = counted.join(written(found, "merged-hits"), ["doc_id", "text_hash"], "left").select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", "hits", "items")
    return joined.mapInArrow(_merge, RESULT)


def _keep(phrases: Phrases, at: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, found = _found(phrases, *string_buffers(batch.column(at)))
            keep = np.ones(batch.num_rows, bool)
            for i, (spans, _) in found.items():
                keep[i] = 20 * int((spans["end"].astype(np.int64) - spans["start"]).sum()) < count[i]
            yield batch.filter(pa.array(keep))

    return kernel


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated rows; all columns and all other rows stay as they are."""
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_keep(Phrases(*first, window), docs.columns.index("text")), docs.schema)
    rows = keyed(docs).select("doc_id", "text", "text_hash")
    found = _hits_by_block(rows, chain([first, second], blocks), window).groupBy("doc_id", "text_hash").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    wide = rows.mapInArrow(_count_words, "doc_id bigint, text_hash bigint, n_words bigint").distinct().join(written(found, "merged-hits"), ["doc_id", "text_hash"])
    keys = "doc_id bigint, text_hash bigint, contaminated boolean"
    bad = written(wide.select("doc_id", "n_words", "hits", "items", "text_hash").mapInArrow(_judge, keys).where("contaminated"), "contaminated")
    doc, held, d, h = (fresh(docs, n) for n in ("__doc", "__hash", "__d", "__h"))
    named = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), held: F.xxhash64("text")})
    gone = bad.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    return named.join(gone, (F.col(doc) == F.col(d)) & (F.col(held) == F.col(h)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _merge([batch]):
            yield pa.RecordBatch.from_arrays([out.column("doc_id"), batch.column(4), out.column("contaminated")], names=["doc_id", "text_hash", "contaminated"])

"""Sliding sentence spans.

Every run of ``run`` consecutive sentences of every document is hashed; runs that
occur more than once anywhere are joined on the hash; each occurrence but the first
(by doc_id, then place) is removed.

A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line break;
its words are compared lower-cased (A-Z) without punctuation.  Sentences without a
word don't count.  A run of fewer than ``min_words`` words is too common to be a
copy; fewer than ``run`` sentences are a run too if they hold LONG words, so that a
long passage of one or two sentences is found.

A run of too few words goes on, sentence by sentence, until it holds ``min_words``, and
two sentences are a run from PAIR words on.  So a stretch of ``run`` sentences and
``min_words`` words always holds a run, however short its sentences or lines are; what
such a stretch may lose is its end, of fewer than ``min_words`` words or ``run``
sentences.  (``lengthen=False`` leaves short runs alone.)

Scale: one map pass ships 33 bytes for each sentence.  Runs repeated within a slice
of 4 MB are settled there, and a task remembers the repeated runs of its slices, so
that a passage on a third of all rows reaches its bucket a few times for each task.

Defined results: a null or empty text has no sentence and yields no span.  A null
doc_id counts as the least id.  Rows alike in doc_id and text are one document.
Ties go to the lower doc_id, then the lower place.  Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks, spans
from sparkloom.llm.common import fresh
from sparkloom.llm.kernels import ALNUM, Words, group_starts, mix64, runs_at, seeds, slices, string_buffers

RUN = 3
MIN_WORDS = 10
LONG = 40
PAIR = 20
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<u8"), ("start", "<u4"), ("end", "<u4"), ("known", "u1")])

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\r\n\x0b\x0c")] = True


def sentences(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
    """Of rows lo..hi: row, hash, words, first byte and byte after the last of each sentence, bytes counted from the row's start."""
    words = Words(raw, offsets, lo, hi, ALNUM)
    n = len(words.hash)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    first, last = int(offsets[lo]), int(offsets[hi])
    part = raw[first:last]
    stop = part == 10
    stop[:-1] |= _STOP[part[:-1]] & _WHITE[part[1:]]
    at = np.flatnonzero(stop) + first
    row = words.row()
    number = np.searchsorted(at, words.start)
    begin = group_starts(row, number)
    end = np.r_[begin[1:], n]
    up = seeds(1, 77)[0]
    place = np.arange(n) - np.repeat(begin, end - begin)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix64(words.hash + place.astype(np.uint64) * up))]
    value = mix64((total[end] - total[begin]) ^ (end - begin).astype(np.uint64))
    row = row[begin]
    # a sentence owns the bytes up to the next stop, closing punctuation included
    after = number[begin]
    close = np.where(after < len(at), at[np.minimum(after, max(len(at) - 1, 0))] + 1 if len(at) else last, last)
    close = np.minimum(close, offsets[lo + row + 1])
    base = offsets[lo + row]
    return row, value, end - begin, words.start[begin] - base, close - base


def _run_places(row: np.ndarray, total: np.ndarray, run: int, min_words: int, lengthen: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of sentences, and where runs of so many begin."""
    for k in range(1, (max(run, min_words) if lengthen else run) + 1):
        n = len(row) - k + 1
        if n <= 0:
            return
        held = total[k:] - total[:-k]
        least = LONG if k < run else min_words
        if lengthen and k == 2 < run:
            least = PAIR
        fit = (row[:n] == row[k - 1 :]) & (held >= least)
        if k > run:  # a sentence less was not enough
            fit &= total[k - 1 : -1] - total[:-k] < min_words
        yield k, np.flatnonzero(fit)


def _map(run: int, min_words: int, n_buckets: int, lengthen: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spans.Firsts()
        for batch in batches:
            doc = batch.column(0).to_numpy()
            text = batch.column(2).to_numpy().view(np.uint64)
            raw, offsets = string_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                row, value, words, start, end = sentences(raw, offsets, lo, hi)
                total = np.r_[0, np.cumsum(words)]
                found = []
                for k, at in _run_places(row, total, run, min_words, lengthen):
                    part = np.empty(len(at), ENTRY)
                    part["key"], part["doc"], part["text"] = runs_at(value, at, k, k), doc[lo + row[at]], text[lo + row[at]]
                    part["start"], part["end"], part["known"] = start[at], end[at + k - 1], 0
                    found.append(part)
                out = np.concatenate(found) if found else np.empty(0, ENTRY)
                if not len(out):
                    continue
                out, later = _later(out)
                first = np.flatnonzero(~later)
                met = np.diff(np.r_[first, len(out)]) > 1
                later[first] = known.later(*(out[c][first] for c in ("key", "doc", "text", "start")), met)
                out["known"] = later
                bucket = np.where(later, spans.doc_bucket(out["doc"], out["text"], n_buckets), blocks.bucket_of(out["key"], n_buckets))
                yield blocks.pack(bucket, out)

    return kernel


def _later(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by key and place without repeats, and which of them are not the first of their key."""
    entries = entries[np.lexsort((entries["start"], entries["text"], entries["doc"], entries["key"]))]
    entries = entries[group_starts(entries["key"], entries["doc"], entries["text"], entries["start"])]
    later = np.ones(len(entries), bool)
    later[group_starts(entries["key"])] = False
    return entries, later


def repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, lengthen: bool = True) -> DataFrame:
    """One row for each removed stretch: doc_id, text_hash, start and end in bytes of the text's UTF-8."""
    n_buckets, parts = blocks.bucket_count(docs), blocks.partition_count(docs)

    def reducer(_: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = entries["known"] > 0
        open_, later = _later(entries[~known])
        found = np.concatenate([entries[known], open_[later]])
        if len(found):
            out = np.empty(len(found), spans.SPAN)
            for name in spans.SPAN.names:
                out[name] = found[name]
            yield blocks.pack(spans.doc_bucket(out["doc"], out["text"], n_buckets), out)

    first = spans.keyed(docs).mapInArrow(_map(run, min_words, n_buckets, lengthen), blocks.BLOCK_SCHEMA)
    return spans.gathered(blocks.reduce_blocks(first, parts, ENTRY, reducer, blocks.BLOCK_SCHEMA), parts)


def without_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, lengthen: bool = True) -> DataFrame:
    """docs with repeated stretches cut out of text; a document of which nothing is left goes.

    All columns stay; n_chars, where there is one, is counted anew for changed texts.
    """
    cuts, doc, held, key, own, new = (fresh(docs, n) for n in ("__cuts", "__doc", "__hash", "__key", "__own", "__new"))
    found = (
        repeated_spans(docs, run, min_words, lengthen)
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
        .select(F.col("doc_id").alias(doc), F.col("text_hash").alias(held), cuts)
    )
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(spans.NULL_ID)), own: F.xxhash64("text")})
    joined = keyed.join(found, (F.col(key) == F.col(doc)) & (F.col(own) == F.col(held)), "left")
    raw = F.encode("text", "UTF-8")
    # what lies between the cuts, joined again
    kept = F.aggregate(
        cuts,
        F.struct(F.lit(1).cast("bigint").alias("at"), F.encode(F.lit(""), "UTF-8").alias("out")),
        lambda a, c: F.struct(
            (c["end"] + 1).alias("at"), F.concat(a["out"], F.substring(raw, a["at"].cast("int"), (c["start"] + 1 - a["at"]).cast("int"))).alias("out")
        ),
        lambda a: F.decode(F.concat(a["out"], F.substring(raw, a["at"].cast("int"), F.lit(2147483647))), "UTF-8"),
    )
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn(new, text).where(F.col(cuts).isNull() | (F.length(F.trim(F.regexp_replace(new, r"\s+", " "))) > 0))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(new).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)

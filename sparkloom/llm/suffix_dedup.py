"""Sparse suffix array over the words of all documents.

Only suffixes at content-selected places are kept: a word place is selected when the
hash of its K-gram is the least of WINDOW consecutive ones (a minimiser), so equal
passages select equal places.  Every stretch of K + WINDOW - 1 = 25 words holds one;
the middle of a passage of MIN_WORDS = 50 words does too, with at most LEFT = 29
words of the passage before it.

1. Each suffix is shipped as a hash of its first RIGHT_KEY = 21 words; suffixes that
   occur once end there.
2. For the rest, the documents are joined back and each suffix carries fingerprints of
   the LEFT words before and RIGHT words from its place on.  A bucket sorts its
   suffixes by what follows and takes the common prefix of neighbours; those without a
   long enough one go.  Matches are extended to the left by the common prefixes of
   neighbours in the order of what comes before, read backwards: to each left extension
   o belongs the window of o words before and 50 - o from the place on, and suffixes
   hold the same one where no common prefix between them is shorter, in either order.
3. A window of 50 words that another document, or the same one earlier, holds too is
   repeated; all occurrences but the first (doc_id, then place) are reported, joined
   into maximal spans.

A word is covered exactly if it lies in a window of 50 words that occurs earlier.
Words are compared lower-cased (A-Z), split at ASCII white space.

Scale: step 1 ships 29 bytes for about every ninth word; repeats within a 4 MB slice
are settled there, both in step 1 and, for equal contexts, in step 2, and a task
remembers the repeats of its slices, so that a hot passage reaches its bucket a few
times for each task.

Defined results: null, empty and short texts yield nothing; a null doc_id counts as
the least; rows alike in doc_id and text are one document; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks, spans
from sparkloom.llm.kernels import SPACED, Words, group_starts, mix64, runs, seeds, slices, string_buffers

MIN_WORDS = 50
K, WINDOW = 8, 18
MARGIN = (MIN_WORDS - (K + WINDOW - 1) + 1) // 2 - 1  # 12
LEFT = MARGIN + WINDOW - 1
RIGHT_KEY = MIN_WORDS - LEFT
RIGHT = MIN_WORDS - MARGIN

FOUND = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<u8"), ("place", "<u4"), ("known", "u1")])
PLACE = np.dtype([("doc", "<i8"), ("text", "<u8"), ("place", "<u4")])
CONTEXT = np.dtype(
    [("key", "<u8"), ("doc", "<i8"), ("text", "<u8"), ("place", "<u4"), ("kind", "u1"), ("n_left", "u1"), ("n_right", "u1"), ("words", "<u4", (LEFT + RIGHT,))]
)


def minimisers(words: Words) -> np.ndarray:
    """Selected places among all words of a slice; the leftmost of equal least hashes."""
    gram = runs(words.hash, K, 3)
    n = len(gram)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    after = words.after()[:n]
    # a window must lie within its row: from place i on, K + WINDOW - 1 words
    picked = []
    step = 1 << 18
    for lo in range(0, n - WINDOW + 1, step):
        part = gram[lo : lo + step + WINDOW - 1]
        least = sliding_window_view(part, WINDOW).argmin(axis=1)
        at = lo + np.arange(len(least)) + least
        whole = after[lo : lo + len(least)] >= K + WINDOW - 1
        picked.append(np.unique(at[whole]))
    return np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)


def _suffixes(n_buckets: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spans.Firsts()
        for batch in batches:
            doc, text = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            raw, offsets = string_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                words = Words(raw, offsets, lo, hi, SPACED)
                at = minimisers(words)
                at = at[words.after()[at] >= RIGHT_KEY] if len(at) else at
                if not len(at):
                    continue
                row, place = words.row()[at], words.place()[at]
                out = np.empty(len(at), FOUND)
                out["key"], out["doc"], out["text"] = runs(words.hash, RIGHT_KEY, 5)[at], doc[lo + row], text[lo + row]
                out["place"], out["known"] = place, 0
                out = _distinct(out)
                begin = group_starts(out["key"])
                size = np.diff(np.r_[begin, len(out)])
                out["known"] = np.repeat(size > 1, size) * 2
                out["known"][begin[size > 1]] = 1
                met = known.later(*(out[c][begin] for c in ("key", "doc", "text", "place")), size > 1)
                out["known"][begin[met]] = 2
                spare = out["known"] == 2
                bucket = np.where(spare, spans.doc_bucket(out["doc"], out["text"], n_buckets), blocks.bucket_of(out["key"], n_buckets))
                yield blocks.pack(bucket, out)

    return kernel


def _distinct(out: np.ndarray) -> np.ndarray:
    out = out[np.lexsort((out["place"], out["text"], out["doc"], out["key"]))]
    return out[group_starts(out["key"], out["doc"], out["text"], out["place"])]


def _repeated(n_buckets: int):
    def reducer(_: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        spare = entries["known"] == 2
        rest = _distinct(entries[~spare])
        begin = group_starts(rest["key"])
        size = np.diff(np.r_[begin, len(rest)])
        many = np.repeat(size > 1, size) | (rest["known"] == 1)
        found = np.concatenate([entries[spare], rest[many]])
        if len(found):
            out = np.empty(len(found), PLACE)
            for name in PLACE.names:
                out[name] = found[name]
            yield blocks.pack(spans.doc_bucket(out["doc"], out["text"], n_buckets), out)

    return reducer


def _by_document(_: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    entries = entries[np.lexsort((entries["place"], entries["text"], entries["doc"]))]
    entries = entries[group_starts(entries["doc"], entries["text"], entries["place"])]
    at = group_starts(entries["doc"], entries["text"])
    ends = np.r_[at[1:], len(entries)]
    places = np.ascontiguousarray(entries["place"])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(entries["doc"][at]),
            pa.array(np.ascontiguousarray(entries["text"][at]).view(np.int64)),
            pa.array([places[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
        ],
        names=["__doc", "__hash", "places"],
    )


def _contexts(n_buckets: int):
    lanes = np.arange(LEFT + RIGHT) - LEFT

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spans.Firsts()
        for batch in batches:
            doc, text = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            raw, offsets = string_buffers(batch.column(1))
            marks = batch.column(3)
            for lo, hi in slices(offsets):
                words = Words(raw, offsets, lo, hi, SPACED)
                own = [np.frombuffer(marks[i].as_py(), np.uint32) for i in range(lo, hi)]
                count = np.array([len(x) for x in own])
                if not count.sum():
                    continue
                row = np.repeat(np.arange(hi - lo), count)
                place = np.concatenate(own).astype(np.int64)
                at = words.begin[row] + place
                grams = runs(words.hash, RIGHT_KEY, 5)
                for a in range(0, len(at), 1 << 15):
                    part = slice(a, a + (1 << 15))
                    yield from _emit(words, grams, at[part], row[part], place[part], doc[lo:hi], text[lo:hi], lanes, n_buckets, known)

    return kernel


def _emit(words, grams, at, row, place, doc, text, lanes, n_buckets, known):
    out = np.zeros(len(at), CONTEXT)
    out["key"], out["doc"], out["text"], out["place"] = grams[at], doc[row], text[row], place
    out["n_left"] = np.minimum(place, LEFT)
    out["n_right"] = np.minimum(words.begin[row + 1] - at, RIGHT)
    where = at[:, None] + lanes[None, :]
    inside = (lanes[None, :] >= -out["n_left"][:, None].astype(np.int64)) & (lanes[None, :] < out["n_right"][:, None])
    out["words"] = np.where(inside, (words.hash[np.clip(where, 0, len(words.hash) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
    # equal contexts of this slice: one goes on, the windows of the others are known to be repeated
    view = np.ascontiguousarray(out["words"]).view(np.dtype((np.void, 4 * (LEFT + RIGHT)))).ravel()
    order = np.lexsort((out["place"], out["text"], out["doc"], np.unique(view, return_inverse=True)[1]))
    out, view = out[order], view[order]
    once = group_starts(out["doc"], out["text"], out["place"])
    out, view = out[once], view[once]
    spare = np.zeros(len(out), bool)
    spare[1:] = view[1:] == view[:-1]
    first = np.flatnonzero(~spare)
    met = np.diff(np.r_[first, len(out)]) > 1
    spare[first] = known.later(runs_of_rows(out["words"][first].astype(np.uint64)), *(out[c][first] for c in ("doc", "text", "place")), met)
    out["kind"] = spare
    bucket = np.where(spare, spans.doc_bucket(out["doc"], out["text"], n_buckets), blocks.bucket_of(out["key"], n_buckets))
    for flag in (False, True):
        if (spare == flag).any():
            yield blocks.pack(bucket[spare == flag], out[spare == flag])


def _windows(out: np.ndarray, o: int) -> np.ndarray:
    return (out["n_left"] >= o) & (out["n_right"] >= MIN_WORDS - o)


def _sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and how many words each has in common with its predecessor in it (the first none)."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), kind="stable")
    held = rows[order]
    same = held[1:] == held[:-1]
    return order, np.r_[0, np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))]


def _extend(n_buckets: int):
    def reducer(_: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        spare, rest = entries[entries["kind"] == 1], entries[entries["kind"] == 0]
        found = []
        for o in range(MARGIN, LEFT + 1):
            own = spare[_windows(spare, o)]
            found.append((own["doc"], own["text"], own["place"] - np.uint32(o)))
        rest = rest[np.lexsort((rest["place"], rest["text"], rest["doc"]))]
        rest = rest[group_starts(rest["doc"], rest["text"], rest["place"])]  # rows repeated as a whole
        if len(rest) > 1:
            # the sparse suffix array: by what follows; a suffix without a long enough match beside it goes
            order, right = _sorted_prefixes(rest["words"][:, LEFT:])
            rest = rest[order]
            keep = np.maximum(right, np.r_[right[1:], 0]) >= RIGHT_KEY
            keep_from = np.flatnonzero(keep)
            # between suffixes kept lie only ones that match neither side
            right = np.minimum.reduceat(right[: keep_from[-1] + 1], np.r_[0, keep_from[:-1] + 1]) if len(keep_from) else right[:0]
            rest = rest[keep]
        else:
            rest, right = rest[:0], np.zeros(0, np.int64)
        if len(rest) > 1:
            # matches of neighbours extended to the left: by what comes before, backwards
            back, left = _sorted_prefixes(rest["words"][:, LEFT - 1 :: -1][:, :LEFT])
            group = np.empty(len(rest), np.int64)
            for o in range(MARGIN, LEFT + 1):
                # suffixes are alike 50 - o words on, and o words back, where no neighbour between them differs earlier
                group[back] = np.cumsum(left < o)
                alike = np.cumsum(right < MIN_WORDS - o) * (len(rest) + 1) + group
                fit = np.flatnonzero(_windows(rest, o))
                if len(fit) < 2:
                    continue
                own, alike = rest[fit], alike[fit]
                by = np.lexsort((own["place"], own["text"], own["doc"], alike))
                own, alike = own[by], alike[by]
                later = np.zeros(len(own), bool)
                later[1:] = alike[1:] == alike[:-1]
                found.append((own["doc"][later], own["text"][later], own["place"][later] - np.uint32(o)))
        doc, text, start = (np.concatenate([f[i] for f in found]) for i in range(3))
        if len(doc):
            out = np.empty(len(doc), spans.SPAN)
            out["doc"], out["text"], out["start"], out["end"] = doc, text, start, start + np.uint32(MIN_WORDS)
            out = spans.merged(out)
            yield blocks.pack(spans.doc_bucket(out["doc"], out["text"], n_buckets), out)

    return reducer


def runs_of_rows(lanes: np.ndarray) -> np.ndarray:
    """A hash of each row of 32-bit fingerprints."""
    return mix64((mix64(lanes) * seeds(lanes.shape[1], 31)[None, :]).sum(axis=1, dtype=np.uint64))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start and end (in words): spans of 50 words or more that occur earlier too."""
    n_buckets, parts = blocks.bucket_count(docs), blocks.partition_count(docs)
    keyed = spans.keyed(docs)
    first = keyed.mapInArrow(_suffixes(n_buckets), blocks.BLOCK_SCHEMA)
    places = blocks.reduce_blocks(first, parts, FOUND, _repeated(n_buckets), blocks.BLOCK_SCHEMA)
    marked = blocks.reduce_blocks(places, parts, PLACE, _by_document, "__doc bigint, __hash bigint, places binary")
    joined = keyed.join(marked, (F.col("doc_id") == F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))).select(
        "doc_id", "text", "text_hash", "places"
    )
    context = joined.mapInArrow(_contexts(n_buckets), blocks.BLOCK_SCHEMA)
    found = blocks.reduce_blocks(context, parts, CONTEXT, _extend(n_buckets), blocks.BLOCK_SCHEMA)
    return spans.gathered(found, parts)

"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct SHINGLE-word shingles (64-bit hashes); with fewer
words, the whole sequence as one.  Two sets link when
``100 * |intersection| >= 75 * |union|``; linked sets of t = x + y features differ in
at most t / 7 of them.

Signatures.  Pairs fall in bands by t.  For a band with at most k differences the
feature domain is cut into n > k partitions by hash and subsets of partitions are
enumerated: for k <= PAIRS_UP_TO all pairs of n = k + 3 partitions, of which a linked
pair agrees on 3 at least; up to BLOCKS_UP_TO the two-level scheme, blocks of three
partitions with all pairs in each; for more, single partitions (subsets of one), n = k
plus a slack, of which at least n - k agree.  (There pairs of partitions would cost as
many signatures, and hold so few features of so large a set that they select no more:
measured 492 signatures a document with blocks up to 60, 488 with none, 491 up to 120.)
More slack costs signatures but lets a set drop more frequent ones: passages that many
documents share then make candidates only of sets that they could link by themselves.
A set signs in every band that holds a t it can have with a partner, with the hash of
its features in each subset.  Sets that agree on a subset share that signature.

Candidates.  ``a`` is the least number of agreeing subsets in a band.  A set may
always drop its a - 1 most frequent signatures, empty ones first: the rarest
signature that a linked pair shares survives at both ends.  Signatures of up to SMALL
sets give pairs with a count of shared signatures; a pair that can't reach the count
that linked sets need, even if all frequent signatures agreed, goes.  Of the more
frequent ones each set keeps those it may not drop; in what is left, members are
first compared with one representative, the one that meets most others; where a group falls into several components
after that, sets of different ones are compared by parity sketches, whose differences
are at most those of the sets.  Every candidate is verified on whole sets.  Nothing is capped or sampled.

Hot signatures.  A signature that CROWD sets of a slice share is frequent by itself: its
members go round its bucket, which gets one mark for all of them.  Marked signatures
rank by their size, or as if every SHARED-th set held them where that is more; so the few
sizes above that (a bounded table) are all that members passing by have to know.  The
comparison by sketches of a group of more than PART sets is cut into pairs of parts, by
component, and no part meets another of its own component.

Only classes of distinct sets take part (``set_id``, a 64-bit hash, with the size);
copies meet in a bucket as one.

Scale: one text pass ships 13 bytes for about each shingle; documents are read again
for candidates alone.  Bucket numbers follow the input.

Defined results: null and empty texts have no set and link with nothing; a null
doc_id counts as the least and comes back as null; repeated rows are copies;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks
from sparkloom.llm.common import discard, fresh, written
from sparkloom.llm.components import components
from sparkloom.llm.kernels import SPACED, Words, group_starts, mix64, ranges, runs, seeds, slices, string_buffers
from sparkloom.llm.spans import NULL_ID, keyed

SHINGLE = 5
SHARE = 75  # percent
PAIRS_UP_TO = 4
BLOCKS_UP_TO, BLOCK_SLACK = 60, 0.8
SMALL = 24
#: Sets of a slice that make a signature hot; the share of sets from which its size counts; sets of a part.
CROWD, SHARED, PART = 24, 1000, 2048
#: Sets that a task remembers as signed.
SIGNED = 1 << 20
#: In place of spare: the entry is a mark, with a count for the set.
MARK = 255
#: Slack as a share of k, by k.
SLACK = ((60, 4.0), (150, 1.5), (400, 0.8), (1 << 62, 0.4))
SKETCH = 1024  # bits
#: Bytes of text, and partitions of sets, that a task holds at a time.
SLICE, CELLS = 1 << 20, 1 << 19
ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("set", "<u8"), ("spare", "u1")])
PAIR = np.dtype([("x", "<u8"), ("y", "<u8"), ("n", "<u4")])
HOT = np.dtype([("sig", "<u8"), ("set", "<u8"), ("size", "<u4"), ("spare", "u1")])
MEMBER = np.dtype([("sig", "<u8"), ("set", "<u8"), ("weight", "<u8")])

_bounds = [6]
while _bounds[-1] < 1 << 40:
    _bounds.append(max(_bounds[-1] + 1, _bounds[-1] * 4 // 3))
#: Greatest t of each band; sets of band 0 link only if they are equal.
BOUNDS = np.array(_bounds, np.int64)


def bands(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last band of sets of these sizes."""
    least = size + -(-SHARE * size // 100)
    most = size + 100 * size // SHARE
    return np.searchsorted(BOUNDS, least), np.searchsorted(BOUNDS, most)


def shape(band: int) -> tuple[int, int, int, np.ndarray]:
    """Differences k, partitions n, agreeing subsets at least, and the subsets: a row of partitions each."""
    k = int(BOUNDS[band]) * (100 - SHARE) // (100 + SHARE)
    if k <= PAIRS_UP_TO:
        return k, k + 3, 3, np.column_stack(np.triu_indices(k + 3, 1))
    if k <= BLOCKS_UP_TO:
        # blocks of three partitions, all pairs in each: of 2 g - k subsets no k differences touch either partition
        g = int(np.ceil((1 + BLOCK_SLACK) * k / 2)) + 2
        return k, 3 * g, 2 * g - k if k > g else 3 * g - 2 * k, np.concatenate([3 * i + np.array([[0, 1], [0, 2], [1, 2]]) for i in range(g)])
    slack = next(share for most, share in SLACK if k < most)
    n = k + int(np.ceil(slack * k)) + 16
    return k, n, n - k, np.arange(n)[:, None]


def sets_of(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows lo..hi, row after row in order, and n + 1 bounds."""
    words = Words(raw, offsets, lo, hi, SPACED)
    row = words.row()
    gram = runs(words.hash, SHINGLE, 9)
    whole = words.after()[: len(gram)] >= SHINGLE
    gram, own = gram[whole], row[: len(whole)][whole]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    extra = []
    for r in short:
        h = words.hash[words.begin[r] : words.begin[r + 1]]
        extra.append(mix64((h * seeds(SHINGLE, 2000 + len(h))[: len(h)]).sum(dtype=np.uint64)))
    if extra:
        gram, own = np.r_[gram, np.array(extra, np.uint64)], np.r_[own, short]
    order = np.lexsort((gram, own))
    gram, own = gram[order], own[order]
    first = group_starts(own, gram)
    gram, own = gram[first], own[first]
    return gram, np.searchsorted(own, np.arange(hi - lo + 1))


def set_ids(gram: np.ndarray, bound: np.ndarray) -> np.ndarray:
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix64(gram * seeds(1, 41)[0]))]
    return mix64(total[bound[1:]] - total[bound[:-1]] + np.diff(bound).astype(np.uint64))


def signatures(gram: np.ndarray, bound: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Signature, set id and how many non-empty signatures may be dropped, band after band."""
    size = np.diff(bound)
    first, last = bands(size)
    for band in range(int(first[size > 0].min(initial=1 << 30)), int(last[size > 0].max(initial=-1)) + 1):
        if band == 0:
            continue
        k, n, agree, subsets = shape(band)
        if k < 1:
            continue
        own = np.flatnonzero((size > 0) & (first <= band) & (band <= last))
        step = max(1, CELLS // n)
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            yield _band_signatures(gram, bound, ids, part, band, n, agree, subsets)


def _cells(gram: np.ndarray, bound: np.ndarray, part: np.ndarray, band: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed features of some sets, and the partition of each, numbered through all of them."""
    count = bound[part + 1] - bound[part]
    mixed = mix64(gram[ranges(bound[part], count)] ^ seeds(1, 5000 + band)[0])
    return mixed, np.repeat(np.arange(len(part)) * n, count) + blocks.bucket_of(mixed, n).astype(np.int64)


def _band_signatures(gram, bound, ids, part, band, n, agree, subsets):
    mixed, cell = _cells(gram, bound, part, band, n)
    total = np.zeros(len(part) * n, np.uint64)
    np.add.at(total, cell, mix64(mixed + seeds(1, 5000 + band)[0]))
    held = np.bincount(cell, minlength=len(part) * n).reshape(len(part), n)
    total = total.reshape(len(part), n)
    m, by = len(subsets), seeds(n, 7000 + band)
    empty = np.ones((len(part), m), bool)
    value = np.zeros((len(part), m), np.uint64)
    for own in subsets.T:
        empty &= held[:, own] == 0
        value += total[:, own] * by[own]
    value = mix64(value + seeds(m, 9000 + band)[None, :])
    n_empty = empty.sum(axis=1)
    # the first agree - 1 empty signatures may be dropped; more than that are signed like others
    keep = ~empty | (np.cumsum(empty, axis=1) > agree - 1)
    spare = np.minimum(MARK - 1, np.maximum(0, agree - 1 - n_empty))
    row, col = np.nonzero(keep)
    return value[row, col], ids[part][row], spare[row].astype(np.uint8)


def needed(size: np.ndarray, bound: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First band of each set, and, by band from there, how many signatures a linked partner shares at least."""
    first, last = bands(size)
    out = np.ones((len(size), 4), np.int64)
    for band in range(int(first[size > 0].min(initial=1 << 30)), int(last[size > 0].max(initial=-1)) + 1):
        k, n, agree, subsets = shape(band)
        if band == 0 or k < 1:
            continue
        own = np.flatnonzero((size > 0) & (first <= band) & (band <= last))
        step = max(1, CELLS // n)
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            held = np.zeros(len(part) * n, bool)
            held[_cells(gram, bound, part, band, n)[1]] = True
            empty = (~held.reshape(len(part), n)[:, subsets]).all(axis=2).sum(axis=1)
            out[part, band - first[part]] = np.maximum(1, agree - np.minimum(agree - 1, empty))
    return first, out


def _hot_sig(sig: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A signature's 40 bits, told from those of other buckets by the bucket's number."""
    return mix64(sig & np.uint64((1 << 40) - 1) ^ bucket.astype(np.uint64) << np.uint64(40))


def _signed(held: list[tuple], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of kind 0 (entries and marks, by signature) and 2 (members of crowded signatures, by set)."""
    sig, own, spare = (np.concatenate([h[i] for h in held]) for i in range(3))
    order = np.argsort(sig, kind="stable")
    sig, own, spare = sig[order], own[order], spare[order]
    begin = group_starts(sig)
    size = np.diff(np.r_[begin, len(sig)])
    hot = size >= CROWD
    crowd = np.repeat(hot, size)
    at = np.r_[np.flatnonzero(~crowd), begin[hot]]
    out = np.empty(len(at), ENTRY)
    out["low"], out["high"] = sig[at] & np.uint64(0xFFFFFFFF), (sig[at] >> np.uint64(32)) & np.uint64(255)
    out["set"], out["spare"] = np.r_[own[~crowd], size[hot].astype(np.uint64)], np.r_[spare[~crowd], np.full(int(hot.sum()), MARK, np.uint8)]
    yield blocks.pack(blocks.bucket_of(mix64(sig[at]), n_buckets) * np.uint64(4), out)
    if crowd.any():
        past = np.empty(int(crowd.sum()), HOT)
        past["sig"], past["set"] = _hot_sig(sig[crowd], blocks.bucket_of(mix64(sig[crowd]), n_buckets)), own[crowd]
        past["size"], past["spare"] = 0, spare[crowd]
        yield blocks.pack(blocks.bucket_of(past["set"], n_buckets) * np.uint64(4) + np.uint64(2), past)


def _sign(n_buckets: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                gram, bound = sets_of(raw, offsets, lo, hi)
                ids = set_ids(gram, bound)
                # copies sign once, within a slice and within a task
                _, at = np.unique(ids, return_index=True)
                at = np.sort(at)
                at = at[np.fromiter((x not in known for x in ids[at].tolist()), bool, len(at))]
                if len(known) < SIGNED:
                    known.update(ids[at].tolist())
                gram = gram[ranges(bound[at], bound[at + 1] - bound[at])]
                bound = np.r_[0, np.cumsum((bound[1:] - bound[:-1])[at])]
                held, size = [], 0
                for found in signatures(gram, bound, ids[at]):
                    held.append(found)
                    size += len(found[0])
                    if size > CELLS:
                        yield from _signed(held, n_buckets)
                        held, size = [], 0
                if held:
                    yield from _signed(held, n_buckets)

    return kernel


SET_SCHEMA = "doc_id bigint, text_hash bigint, set_id bigint, n bigint, band bigint, need array<bigint>"


def _set_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = string_buffers(batch.column(1))
        for lo, hi in slices(offsets, SLICE):
            gram, bound = sets_of(raw, offsets, lo, hi)
            size = np.diff(bound)
            first, need = needed(size, bound, gram)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(2).slice(lo, hi - lo),
                    pa.array(set_ids(gram, bound).view(np.int64)),
                    pa.array(size.astype(np.int64)),
                    pa.array(first.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * need.shape[1]), pa.array(need.ravel())),
                ],
                names=["doc_id", "text_hash", "set_id", "n", "band", "need"],
            )


def _groups(low: np.ndarray, high: np.ndarray, own: np.ndarray):
    """Order by signature and set, and where groups of equal signatures begin."""
    sig = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    order = np.lexsort((own, sig))
    return order, sig[order]


def _pairs_of(own: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of each group (members sorted)."""
    xs, ys = [], []
    for g in np.unique(size):
        at = begin[size == g]
        a, b = np.triu_indices(int(g), 1)
        xs.append(own[at[:, None] + a[None, :]].ravel())
        ys.append(own[at[:, None] + b[None, :]].ravel())
    none = np.zeros(0, np.uint64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


def _counted(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    at = group_starts(x, y)
    out = np.empty(len(at), PAIR)
    out["x"], out["y"] = x[at], y[at]
    total = np.r_[0, np.cumsum(np.ones(len(x), np.int64) if n is None else n[order].astype(np.int64))]
    out["n"] = total[np.r_[at[1:], len(x)]] - total[at] if len(at) else 0
    return out


def _pair_bucket(x, y, n):
    return blocks.bucket_of(mix64(x * np.uint64(3) ^ mix64(y)), n)


def _match(n_buckets: int, small: int, common: int):
    """Blocks of kind 0: pairs of small groups; 1: members of large ones; 3: sizes of marked signatures above ``common``."""

    def reducer(bucket: int, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        if bucket % 4 == 2:
            yield blocks.pack(np.full(len(e), bucket), e)
            return
        bucket //= 4
        order, sig = _groups(e["low"], e["high"], e["set"])
        e = e[order]
        begin = group_starts(sig)
        names, marked = sig[begin], e["spare"] == MARK
        extra = np.add.reduceat(np.where(marked, e["set"], 0), begin) if len(e) else e["set"]
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(e)]))
        once = np.zeros(len(e), bool)
        once[group_starts(sig, e["set"], marked)] = True
        own = np.flatnonzero(once & ~marked)
        e, sig, group = e[own], sig[own], group[own]
        size = np.bincount(group, minlength=len(begin))  # members that came here
        first = np.searchsorted(group, np.arange(len(begin)))
        few = (size > 1) & (size <= small) & (extra == 0)
        pairs = _counted(*_pairs_of(np.ascontiguousarray(e["set"]), first[few], size[few]))
        if len(pairs):
            yield blocks.pack(_pair_bucket(pairs["x"], pairs["y"], n_buckets) * np.uint64(4), pairs)
        total = np.where(extra > 0, np.maximum(size + extra.astype(np.int64), common), size)
        many = (size > small) | (extra > 0)
        if many.any():
            at = ranges(first[many], size[many])
            out = np.empty(len(at), HOT)
            out["sig"], out["set"] = _hot_sig(sig[at], np.full(len(at), bucket, np.uint64)), e["set"][at]
            out["size"], out["spare"] = np.minimum(np.repeat(total[many], size[many]), 0xFFFFFFFF), e["spare"][at]
            if len(out):
                yield blocks.pack(blocks.bucket_of(out["set"], n_buckets) * np.uint64(4) + np.uint64(1), out)
        known = (extra > 0) & (total > common)
        if known.any():
            sizes = np.zeros(int(known.sum()), HOT)
            sizes["sig"], sizes["size"] = _hot_sig(names[known], np.full(len(sizes), bucket, np.uint64)), np.minimum(total[known], 0xFFFFFFFF)
            yield blocks.pack(np.full(len(sizes), 3), sizes)

    return reducer


def _sized(sizes: np.ndarray, common: int):
    """Members that passed by their buckets, with the sizes of their signatures."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                e = np.frombuffer(payload.as_py(), HOT).copy()
                at = np.searchsorted(sizes["sig"], e["sig"])
                at[at == len(sizes)] = 0
                e["size"] = np.where(sizes["sig"][at] == e["sig"], sizes["size"][at], common) if len(sizes) else common
                yield blocks.pack(np.full(len(e), bucket - 1), e)

    return kernel


def _sum_pairs(_: int, e: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = _counted(e["x"], e["y"], e["n"])
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[c]).view(np.int64)) for c in ("x", "y")] + [pa.array(out["n"].astype(np.int64))], names=["x", "y", "n"])


def _cool(n_buckets: int):
    """Of each set's frequent signatures those that it may not drop."""

    def reducer(_: int, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = e[np.lexsort((e["sig"], -e["size"].astype(np.int64), e["set"]))]
        e = e[group_starts(e["set"], e["sig"])]  # copies that signed in several tasks
        begin = group_starts(e["set"])
        size = np.diff(np.r_[begin, len(e)])
        place = np.arange(len(e)) - np.repeat(begin, size)
        spare = np.repeat(np.minimum.reduceat(e["spare"], begin), size) if len(e) else e["spare"]
        # how many other sets a set meets in all: an original meets more than its edited copies do
        weight = np.repeat(np.add.reduceat(e["size"].astype(np.uint64), begin), size) if len(e) else e["set"]
        keep = place >= spare
        rest, weight = e[keep], weight[keep]
        if len(rest):
            out = np.empty(len(rest), MEMBER)
            out["sig"], out["set"], out["weight"] = rest["sig"], rest["set"], weight
            yield blocks.pack(blocks.bucket_of(mix64(out["sig"]), n_buckets), out)

    return reducer


def _hot_counts(_: int, e: np.ndarray) -> Iterator[pa.RecordBatch]:
    e = e[np.lexsort((e["sig"], e["set"]))]
    own, n = np.unique(e["set"][group_starts(e["set"], e["sig"])], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["set_id", "hot"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(1):
            part = np.frombuffer(payload.as_py(), MEMBER)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c]).view(np.int64)) for c in ("sig", "set", "weight")], names=["sig", "set_id", "weight"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = string_buffers(batch.column(1))
        for lo, hi in slices(offsets, SLICE):
            gram, bound = sets_of(raw, offsets, lo, hi)
            data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((bound * 8).astype(np.int32)), pa.py_buffer(gram)])
            sketch = [np.packbits(np.bincount((gram[a:b] >> np.uint64(54)).astype(np.int64), minlength=SKETCH) & 1) for a, b in zip(bound, bound[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bound)), pa.array([x.tobytes() for x in sketch], pa.binary()), data],
                names=["set_id", "n", "sketch", "grams"],
            )


def _across(n_buckets: int):
    """Of rows sorted by key: pairs of different components whose sizes and sketches allow a link, in blocks.

    A key is a signature, or a pair of parts of one, whose sides are a and b.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for own in _keyed(batches):
            for x, y in _compared(own):
                held.append(_counted(x, y))
                size += len(x)
                if size > CELLS:
                    yield _pair_blocks(held, n_buckets)
                    held, size = [], 0
        if held:
            yield _pair_blocks(held, n_buckets)

    return kernel


_SKETCHED = np.dtype([("key", "<i8"), ("set", "<i8"), ("root", "<i8"), ("n", "<i8"), ("side", "u1"), ("sketch", "<u8", (SKETCH // 64,))])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of each key, from sorted batches."""
    held = np.empty(0, _SKETCHED)
    for batch in batches:
        part = np.empty(batch.num_rows, _SKETCHED)
        for name in ("key", "set", "root", "n", "side"):
            part[name] = batch.column(name).to_numpy()
        part["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        held = np.concatenate([held, part])
        at = group_starts(held["key"])
        for a, b in zip(at, at[1:], strict=False):
            yield held[a:b]
        held = held[at[-1] :] if len(at) else held
    if len(held):
        yield held


def _pair_blocks(held: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    both = np.concatenate(held)
    both = _counted(both["x"], both["y"], both["n"])
    return blocks.pack(_pair_bucket(both["x"], both["y"], n_buckets), both)


def _compared(members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    members = members[np.argsort(members["n"], kind="stable")]  # by size, so that sizes that don't fit are ranges
    ids, root, n, side, sketch = (np.ascontiguousarray(members[c]) for c in ("set", "root", "n", "side", "sketch"))
    two = bool(side.any())
    for lo in range(0, len(members), 64):
        a = slice(lo, lo + 64)
        to = int(np.searchsorted(n, n[a][-1] * 100 // SHARE, side="right"))  # what the largest of the part fits
        b = slice(lo, to)
        fits = (root[a, None] != root[None, b]) & (np.arange(lo, to)[None, :] > np.arange(lo, lo + len(n[a]))[:, None])
        fits &= 100 * n[a, None] >= SHARE * n[None, b]
        if two:
            fits &= side[a, None] != side[None, b]
        i, j = np.nonzero(fits)
        for at in range(0, len(i), 1 << 16):
            p, r = lo + i[at : at + (1 << 16)], lo + j[at : at + (1 << 16)]
            apart = np.bitwise_count(sketch[p] ^ sketch[r]).sum(axis=1, dtype=np.int64)
            keep = apart * (100 + SHARE) <= (n[p] + n[r]) * (100 - SHARE)
            if keep.any():
                x, y = ids[p[keep]].view(np.uint64), ids[r[keep]].view(np.uint64)
                yield np.minimum(x, y), np.maximum(x, y)


def _in_parts(members: DataFrame, part: int) -> DataFrame:
    """key, set, root, n, side, sketch of the members (sig, set_id, root, n, sketch) of large groups, for every pair of parts.

    Components of more than ``part`` members are cut into parts of their own, which don't
    meet each other; the rest of a group shares parts.
    """
    counts = members.groupBy("sig", "root").agg(F.count("*").alias("c"))
    own = F.when(F.col("c") > part, F.col("root"))
    parts = counts.groupBy("sig", own.alias("big")).agg(F.sum("c").alias("c")).withColumn("parts", F.ceil(F.col("c") / part).cast("int"))
    parts = written(parts.select("sig", "big", "parts"), "parts")
    numbered = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    side = lambda c: numbered.select("sig", F.col("big").alias(f"big_{c}"), F.col("part").alias(f"part_{c}"))
    place = lambda c: F.struct(F.col(f"big_{c}"), F.col(f"part_{c}"))
    meets = side("a").join(side("b"), "sig").where((place("a") < place("b")) & ~F.col("big_a").eqNullSafe(F.col("big_b")) | F.col("big_a").isNull() & F.col("big_b").isNull() & (F.col("part_a") <= F.col("part_b")))
    meets = meets.withColumn("key", F.xxhash64("sig", F.col("big_a").isNull(), "big_a", "part_a", F.col("big_b").isNull(), "big_b", "part_b"))
    meets = meets.select("sig", "key", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("big_a").alias("big"), F.col("part_a").alias("part")), F.struct(F.lit(1).alias("side"), F.col("big_b").alias("big"), F.col("part_b").alias("part")))))
    # a part that meets itself comes once, as side 0
    meets = meets.groupBy("sig", "key", F.col("big").isNull().alias("pooled"), F.coalesce("big", F.lit(0)).alias("big"), "part").agg(F.min("side").alias("side"))
    bigs = parts.select("sig", F.col("big").alias("root"), F.col("parts").alias("own_parts")).where("root IS NOT NULL")
    pools = parts.where("big IS NULL").select("sig", F.col("parts").alias("pool_parts"))
    dealt = members.join(bigs, ["sig", "root"], "left").join(pools, "sig", "left")
    dealt = dealt.withColumns({"pooled": F.col("own_parts").isNull(), "big": F.when(F.col("own_parts").isNotNull(), F.col("root")).otherwise(F.lit(0))})
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set_id"), F.coalesce("own_parts", "pool_parts")).cast("int"))
    return dealt.join(meets, ["sig", "pooled", "big", "part"]).select("key", F.col("set_id").alias("set"), "root", "n", F.col("side").cast("int").alias("side"), "sketch")


def _bands_column(t):
    """Band of a sum of sizes, as a Column."""
    return F.size(F.filter(F.array(*(F.lit(int(b)) for b in BOUNDS)), lambda b: b < t))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gx, gy, keep = batch.column("gx"), batch.column("gy"), np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = np.frombuffer(gx[i].as_py(), np.uint64), np.frombuffer(gy[i].as_py(), np.uint64)
            if 100 * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = 100 * both >= SHARE * (len(a) + len(b) - both)
        yield batch.filter(pa.array(keep)).select(["x", "y"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    sx = sets.select(F.col("set_id").alias("x"), F.col("grams").alias("gx"))
    sy = sets.select(F.col("set_id").alias("y"), F.col("grams").alias("gy"))
    return pairs.join(sx, "x").join(sy, "y").select("x", "y", "gx", "gy").mapInArrow(_verify, "x bigint, y bigint")


def joined(docs: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """doc_id (the null id as NULL_ID), text_hash, n_shingles, component_id of every row."""
    n_buckets, parts = blocks.bucket_count(docs), blocks.partition_count(docs)
    rows = keyed(docs)
    table = written(rows.mapInArrow(_set_table, SET_SCHEMA), "sets")
    common = max(small, table.count() // SHARED)
    found = written(blocks.reduce_blocks(rows.mapInArrow(_sign(n_buckets), blocks.BLOCK_SCHEMA), parts, {0: ENTRY, 2: HOT}, _match(n_buckets, small, common), blocks.BLOCK_SCHEMA), "matches")
    discard()
    kind = lambda k: found.where(F.col("bucket") % 4 == k)
    # sizes above ``common``, of which there are at most SHARED times the signatures of a set
    sizes = np.concatenate([np.empty(0, HOT), *(np.frombuffer(r["payload"], HOT) for r in kind(3).collect())])
    sizes = sizes[np.argsort(sizes["sig"])]
    hot = kind(1).union(kind(2).mapInArrow(_sized(sizes, common), blocks.BLOCK_SCHEMA))
    hot_counts = blocks.reduce_blocks(hot, parts, HOT, _hot_counts, "set_id bigint, hot bigint")
    cooled = written(blocks.reduce_blocks(hot, parts, HOT, _cool(n_buckets), blocks.BLOCK_SCHEMA), "frequent")
    members = written(cooled.mapInArrow(_members, "sig bigint, set_id bigint, weight bigint").distinct(), "members")
    discard(cooled, collect=False)
    # each member of a frequent signature with the one of the greatest weight
    heads = written(members.groupBy("sig").agg(F.max(F.struct("weight", "set_id")).alias("h")).select("sig", F.col("h.set_id").alias("head")), "heads")
    a, b = F.col("set_id"), F.col("head")
    stars = members.join(heads, "sig").where(a != b).select(_lesser(a, b).alias("x"), _greater(a, b).alias("y")).distinct()
    weighed, members = members, members.drop("weight")

    # pairs whose sizes fit and whose shared signatures, were all frequent ones among them, can suffice
    sets = table.where("n > 0").groupBy("set_id", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"), F.first("band").alias("band"), F.first("need").alias("need"))
    sets = written(sets.join(hot_counts, "set_id", "left").withColumn("hot", F.coalesce("hot", F.lit(0))), "distinct-sets")
    side = lambda c: sets.select(F.col("set_id").alias(c), *(F.col(x).alias(x + c) for x in ("n", "band", "need", "hot")))
    pairs = blocks.reduce_blocks(kind(0), parts, PAIR, _sum_pairs, "x bigint, y bigint, n bigint")
    sized = pairs.join(side("x"), "x").join(side("y"), "y").where(f"100 * least(nx, ny) >= {SHARE} * greatest(nx, ny)")
    band = _bands_column(F.col("nx") + F.col("ny"))
    reach = F.col("n") + F.least("hotx", "hoty")
    enough = lambda c: reach >= F.coalesce(F.get(f"need{c}", F.col("__band") - F.col(f"band{c}")), F.lit(1))
    likely = sized.withColumn("__band", band).where(enough("x") & enough("y")).select("x", "y")
    likely = written(likely.union(stars).distinct(), "likely")
    discard(found, heads)

    # one document stands for each set that is a candidate
    wanted = likely.select(F.explode(F.array("x", "y")).alias("set_id")).union(members.select("set_id")).distinct()
    chosen = sets.join(wanted, "set_id").select("set_id", F.col("d.doc_id").alias("c_doc"), F.col("d.text_hash").alias("c_hash"))
    texts = rows.join(chosen, (F.col("doc_id") == F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash"))).select("set_id", "text")
    grams = written(texts.dropDuplicates(["set_id"]).mapInArrow(_fetch, "set_id bigint, n bigint, sketch binary, grams binary"), "candidate-sets")
    links = _verified(likely, grams)
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    # frequent signatures whose members fell into several components: across those
    placed = written(members.join(roots, F.col("set_id") == F.col("node"), "left").select("sig", "set_id", F.coalesce("root", "set_id").alias("root")), "placed")
    split = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    split = written(split.select("sig", "size"), "split")
    open_ = placed.join(split, "sig").join(grams.select("set_id", "n", "sketch"), "set_id").select("sig", "size", "set_id", "root", "n", "sketch")
    whole = open_.where(F.col("size") <= part).select(F.col("sig").alias("key"), F.col("set_id").alias("set"), "root", "n", F.lit(0).alias("side"), "sketch")
    if not split.where(F.col("size") > part).isEmpty():
        whole = whole.union(_in_parts(open_.where(F.col("size") > part).drop("size"), part))
    across = whole.repartition("key").sortWithinPartitions("key").mapInArrow(_across(n_buckets), blocks.BLOCK_SCHEMA)
    across = blocks.reduce_blocks(across, parts, PAIR, _sum_pairs, "x bigint, y bigint, n bigint").select("x", "y")
    more = written(_verified(across, grams), "links")
    discard(grams, likely, placed, weighed, split)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("x", "y")))
    discard(more, collect=False)
    # the least document of each component, from one row for each distinct set
    named = sets.select("set_id", F.col("d.doc_id").alias("first")).join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "first", F.coalesce("root", "set_id").alias("root"))
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "least-documents")
    named = written(named.join(least, "root").select("set_id", "component_id"), "set-components")
    discard(sets, least, collect=False)
    out = table.join(named, "set_id", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _lesser(a, b):
    """Of two set ids as unsigned numbers, the lesser: the order of packed pairs."""
    return F.when((a >= 0) == (b >= 0), F.least(a, b)).otherwise(F.greatest(a, b))


def _greater(a, b):
    return F.when((a >= 0) == (b >= 0), F.greatest(a, b)).otherwise(F.least(a, b))


def report(docs: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return joined(docs, small, part).select(null("doc_id"), "n_shingles", null("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (ties: least text hash, one row)."""
    groups = joined(docs)
    keep = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash")
    lone = groups.where("n_shingles = 0").select("doc_id", "text_hash").distinct()
    doc, held, d, h = (fresh(docs, n) for n in ("__doc", "__hash", "__d", "__h"))
    chosen = keep.union(lone).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    named = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), held: F.xxhash64("text")})
    kept = named.join(chosen, (F.col(doc) == F.col(d)) & (F.col(held) == F.col(h)), "left_semi")
    # rows alike in doc_id and text are copies of each other
    return kept.dropDuplicates([doc, held]).select(*[F.col(f"`{c}`") for c in docs.columns])

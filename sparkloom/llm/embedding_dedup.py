"""Near-duplicate vectors by spherical-cap filters.

Filters are the words of a random product code: the (rotated) space is cut into blocks,
each with some random unit vectors; a filter is one code vector of every block.  A
vector belongs to all filters whose product with it exceeds the cap's bound, however
many they are: the bound that random unit vectors of its length exceed for FILTERS
filters on average.  Where fewer than LEAST filters reach it (they crowd elsewhere), a
vector has a lower one of its own.  Of 1,500 pairs at cosine 0.93 exactly 98 % share a
filter, at 0.95 99 %; what misses does so by chance of the code, nothing is cut off.
Filters are list-decoded from the products with both halves of the blocks.  The code
grows with the table (SPARE filters a vector), so that vectors that have nothing to do
with each other share a filter no more often in a large table than in a small one.

1. A vector is entered, under its label, in each of its filters with its id and a
   sketch of SKETCH signs; vectors themselves aren't shipped.  Entries whose sketch has
   a partner within NEAR signs in their filter survive; in filters of more than GROUP
   entries, and in those that crowd a map batch, all do.  (Two vectors of cosine 0.93
   differ in 15 of 128 signs on average, in more than NEAR once in 10**8 pairs.)
2. Survivors are joined to their vectors and compared exactly, in double precision,
   filter by filter; pairs are linked from cosine THRESHOLD on.

Exact copies are one class with a multiplicity.  A pair of classes that shares several
filters is counted only in the least of them.  Groups of more than GROUP classes are
cut into pairs of parts, each a task of its own; a task hands on counts and the
links of a spanning forest, not all pairs.

Scale: 32 bytes for each filter of each vector (39 on average and up to 486 of check_l),
then the vectors of survivors once for each surviving filter.  A filter that holds a
share of all vectors (CROWD entries of a batch) goes round its bucket.

Defined results: vectors of different lengths don't link; null, zero, empty or
non-finite vectors and null labels link with nothing (n_links 0, component their own
id); repeated rows are other vectors with the same id; a null vec_id counts as the
least id and is returned as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks
from sparkloom.llm.common import discard, written
from sparkloom.llm.components import components
from sparkloom.llm.kernels import group_starts, mix64, ranges, seeds
from sparkloom.llm.spans import NULL_ID

THRESHOLD = 0.93
FILTERS, LEAST, GROUP, CROWD = 28, 14, 1024, 16
#: Filters of the code for each vector, and codes of a block at least and at most.
SPARE, FEWEST, MOST = 6, 16, 64
SKETCH, NEAR = 128, 38
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("sketch", "<u8", (SKETCH // 64,))])
SURVIVOR = np.dtype([("id", "<i8"), ("key", "<u8")])
#: So many links of a group are held against lesser filters one by one.
FEW_LINKS = 6
#: Stands for the id in an entry that marks a crowded filter.
CROWDED = -1


def code_shape(n: int) -> tuple[int, int]:
    """Blocks and codes of a block for n vectors."""
    want = max(1, SPARE * n)
    for n_blocks in (4, 6, 8):
        codes = int(np.ceil(want ** (1 / n_blocks)))
        if codes <= MOST:
            break
    return n_blocks, min(MOST, max(FEWEST if n_blocks == 4 else 2, codes))


class ProductCode:
    """List decoder of a random product code for vectors of one length."""

    def __init__(self, dim: int, n_blocks: int, codes: int, filters: int = FILTERS, least: int = LEAST, seed: int = 5):
        rng = np.random.default_rng((seed, dim))
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        self.signs = rng.standard_normal((dim, SKETCH))
        self.cuts = np.linspace(0, dim, n_blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            c = rng.standard_normal((codes, max(b - a, 1)))[:, : b - a]
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))
        # the bound is the place from the top that all filters of all probes leave to ``filters`` a probe
        probe = rng.standard_normal((24, dim))
        left, right = self._halves(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        self.per_half, self.least = right.shape[1], min(least, left.shape[1] * right.shape[1])
        most = min(len(probe) * filters, left.size * right.shape[1])
        top = [self._above(x, y, self._bound_for(x, y, 16 * filters))[2] for x, y in zip(left, right, strict=True)]
        self.bound = float(np.sort(np.concatenate(top))[::-1][:most][-1])

    def _bound_for(self, left: np.ndarray, right: np.ndarray, n: int) -> float:
        """A bound that at least n filters (or all) reach."""
        n = min(n, len(left) * len(right))
        k = min(len(left), len(right), int(np.ceil(np.sqrt(n))))
        return float(np.sort(left)[::-1][:k][-1] + np.sort(right)[::-1][: -(-n // k)][-1])

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of unit vectors with every combination of codes of the first and of the last blocks."""
        y = x @ self.rotation
        p = [y[:, a:b] @ c.T for (a, b), c in zip(zip(self.cuts, self.cuts[1:], strict=False), self.codes, strict=True)]
        half = len(p) // 2
        return self._sums(p[:half], len(x)), self._sums(p[half:], len(x))

    def _sums(self, parts: list[np.ndarray], n: int) -> np.ndarray:
        total = parts[0]
        for p in parts[1:]:
            total = (total[:, :, None] + p[:, None, :]).reshape(n, -1)
        return total

    @staticmethod
    def _above(left: np.ndarray, right: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left and right combinations whose sum reaches the bound, and the sums."""
        a, b = np.flatnonzero(left >= bound - right.max()), np.flatnonzero(right >= bound - left.max())
        total = left[a, None] + right[None, b]
        i, j = np.nonzero(total >= bound)
        return a[i], b[j], total[i, j]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filters of each unit vector."""
        left, right = self._halves(x)
        out = []
        for u, v in zip(left, right, strict=True):
            bound = self.bound
            while True:
                a, b, _ = self._above(u, v, bound)
                if len(a) >= self.least:
                    break
                bound -= max(abs(self.bound), 1e-3) / 32
            out.append(np.sort(a.astype(np.int64) * self.per_half + b))
        return out

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(x @ self.signs > 0, axis=1)).view(np.uint64)


def _units(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and unit vectors of a batch, by length."""
    column = batch.column("embedding")
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.asarray(column.offsets)[:-1] - np.asarray(column.offsets)[0]
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        raw = flat[ranges(begin[at], np.full(len(at), dim))].reshape(len(at), int(dim))
        yield int(dim), at, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _enter(n_buckets: int, n_blocks: int, n_codes: int):
    """Entries of each vector in each of its filters; those of crowded filters as survivors, of another kind."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            found = []
            ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy().astype(np.int64).view(np.uint64)
            for dim, at, unit in _units(batch):
                if dim not in codes:
                    codes[dim] = ProductCode(dim, n_blocks, n_codes)
                for lo in range(0, len(at), 512):
                    part, x = at[lo : lo + 512], unit[lo : lo + 512]
                    filters, sketch = codes[dim].decode(x), codes[dim].sketch(x)
                    count = np.array([len(f) for f in filters])
                    out = np.empty(int(count.sum()), ENTRY)
                    s = seeds(2, 70 + dim)
                    out["key"] = mix64(np.concatenate(filters).astype(np.uint64) * s[0] + np.repeat(mix64(label[part] * s[1]), count))
                    out["id"], out["sketch"] = np.repeat(ids[part], count), np.repeat(sketch, count, axis=0)
                    found.append(out)
            if not found:
                continue
            out = np.concatenate(found)
            out = out[np.argsort(out["key"], kind="stable")]
            begin = group_starts(out["key"])
            size = np.diff(np.r_[begin, len(out)])
            crowd = np.repeat(size >= CROWD, size)
            marks = np.zeros(int((size >= CROWD).sum()), ENTRY)
            marks["key"], marks["id"] = out["key"][begin[size >= CROWD]], CROWDED
            plain = np.concatenate([out[~crowd], marks])
            yield blocks.pack(blocks.bucket_of(plain["key"], n_buckets) * np.uint64(4), plain)
            if crowd.any():
                yield _survivors(out["id"][crowd], out["key"][crowd], n_buckets, np.uint64(4), np.uint64(1))

    return kernel


def _survivors(ids: np.ndarray, key: np.ndarray, n_buckets: int, by: int = 1, plus: int = 0) -> pa.RecordBatch:
    out = np.empty(len(ids), SURVIVOR)
    out["id"], out["key"] = ids, key
    return blocks.pack(blocks.bucket_of(mix64(out["id"].view(np.uint64)), n_buckets) * np.uint64(by) + np.uint64(plus), out)


def _near(sketch: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which entries have a partner within NEAR signs in their group."""
    out = np.zeros(len(sketch), bool)
    for g in np.unique(size):
        at = begin[size == g]
        step = max(1, (1 << 20) // int(g * g))
        for lo in range(0, len(at), step):
            rows = at[lo : lo + step, None] + np.arange(g)
            held = sketch[rows]
            apart = np.bitwise_count(held[:, :, None] ^ held[:, None, :]).sum(axis=3, dtype=np.int32)
            apart[:, np.arange(g), np.arange(g)] = SKETCH
            out[rows] = (apart <= NEAR).any(axis=2)
    return out


def _meet(n_buckets: int):
    def reducer(_: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        entries = entries[np.lexsort((entries["id"], entries["key"]))]
        begin = group_starts(entries["key"])
        size = np.diff(np.r_[begin, len(entries)])
        crowded = (entries["id"][begin] == CROWDED) | (size > GROUP)
        keep = np.repeat(crowded, size) & (entries["id"] != CROWDED)
        few = ~crowded & (size > 1)
        keep |= _near(entries["sketch"], begin[few], size[few])
        if keep.any():
            yield _survivors(entries["id"][keep], entries["key"][keep], n_buckets)

    return reducer


def _by_vector(_: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id and its surviving filters."""
    entries = entries[np.lexsort((entries["key"], entries["id"]))]
    begin = group_starts(entries["id"])
    keys = np.ascontiguousarray(entries["key"])
    ends = np.r_[begin[1:], len(entries)]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(entries)].astype(np.int32)), pa.array(keys.view(np.int64)))
    yield pa.RecordBatch.from_arrays([pa.array(entries["id"][begin]), lists, pa.array([keys[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary())], names=["id", "keys", "filters"])


def _shares_lesser(a: list[np.ndarray], b: list[np.ndarray], link: np.ndarray) -> np.ndarray:
    """Which linked members of a and b have a lesser filter in common."""
    out = np.zeros(link.shape, bool)
    i, j = np.nonzero(link)
    if len(i) <= FEW_LINKS:
        for x, y in zip(i, j, strict=True):
            out[x, y] = len(np.intersect1d(a[x], b[y], assume_unique=True)) > 0
        return out
    rows, cols = np.unique(i), np.unique(j)
    low_a, low_b = [a[x] for x in rows], [b[y] for y in cols]
    flat_a, flat_b = np.concatenate(low_a), np.concatenate(low_b)
    both = np.intersect1d(flat_a, flat_b)
    met = np.zeros((len(rows), len(cols)), bool)
    for lo in range(0, len(both), 2048):
        part = both[lo : lo + 2048]
        ma, mb = _indicator(low_a, flat_a, part), _indicator(low_b, flat_b, part)
        met |= (ma @ mb.T) > 0.5
    out[np.ix_(rows, cols)] = met
    return out


def _indicator(rows: list[np.ndarray], flat: np.ndarray, part: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.searchsorted(part, flat)
    at[at == len(part)] = 0
    ok = part[at] == flat
    m = np.zeros((len(rows), len(part)), np.float32)
    m[row[ok], at[ok]] = 1
    return m


class _Part:
    """Members of one side of a group: ids, multiplicities, filters below the group's and unit vectors."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.mult = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.filters = [np.frombuffer(r[2], np.uint64) for r in rows]
        raw = np.array([r[3] for r in rows], np.float64)
        self.unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _compared(a: _Part, b: _Part, threshold: float, same: bool) -> Iterator[tuple]:
    """(id, None, links) and (id, least linked id, 0) of a pair of parts."""
    link = a.unit @ b.unit.T >= threshold
    if same:
        np.fill_diagonal(link, False)
    if not link.any():
        return
    link &= ~_shares_lesser(a.filters, b.filters, link)
    if not link.any():
        return
    counts = [link @ b.mult, a.mult @ link]
    for side, part in ((0, a), (1, b)) if not same else ((0, a),):
        for i in np.flatnonzero(counts[side]):
            yield int(part.ids[i]), None, int(counts[side][i])
    la, lb, big = a.ids.copy(), b.ids.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(link, lb[None, :], big).min(axis=1))
        nb = np.minimum(lb, np.where(link, na[:, None], big).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    for part, least in ((a, la), (b, lb)):
        for x, y in zip(part.ids, least, strict=True):
            if x != y:
                yield int(x), int(y), 0


def _compare(threshold: float):
    """Counts and spanning links of each (key, pair of parts)."""

    def rows_of(batches):
        for batch in batches:
            at = np.asarray(batch.column("embedding").offsets)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            vectors = [flat[x:y] for x, y in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q", "part", "id", "mult", "filters")), vectors, strict=True)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, p, q), own in groupby(rows_of(batches), key=lambda r: r[:3]):
            sides = {p: [], q: []}
            for r in own:
                sides[r[3]].append(r[4:])
            if not all(sides.values()) or p == q and len(sides[p]) < 2:
                continue
            a = _Part(sides[p])
            out += _compared(a, a if p == q else _Part(sides[q]), threshold, p == q)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return kernel


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])


def _survived(classes: DataFrame, n: int) -> DataFrame:
    """id, keys, filters of every class that may have a partner."""
    n_buckets, parts = blocks.bucket_count(classes), blocks.partition_count(classes)
    entered = classes.select("id", "label", "embedding").mapInArrow(_enter(n_buckets, *code_shape(n)), blocks.BLOCK_SCHEMA)
    meet = _meet(n_buckets)

    def reducer(bucket: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        # plain entries meet in their filter's bucket, those of crowded filters pass it by
        yield from meet(bucket, entries) if bucket % 4 == 0 else (_survivors(entries["id"], entries["key"], n_buckets),)

    met = blocks.reduce_blocks(entered, parts, {0: ENTRY, 1: SURVIVOR}, reducer, blocks.BLOCK_SCHEMA)
    return blocks.reduce_blocks(met, parts, SURVIVOR, _by_vector, "id bigint, keys array<bigint>, filters binary")


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    e = F.col("embedding").cast("array<double>")
    usable = F.coalesce(
        F.col("label").isNotNull()
        & (F.size(e) > 0)
        & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(e, lambda v: v != 0),
        F.lit(False),
    )
    base = vectors.select(
        F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NULL_ID)).alias("vec"), F.col("label").cast("bigint").alias("label"), F.col("embedding"), usable.alias("usable")
    ).withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64("embedding", "label", F.lit(1))})
    classes = (
        base.where("usable")
        .groupBy("k1", "k2")
        .agg(F.min("vec").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    )
    # numbered once, when written: a class's id is the same in every job
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    survived = written(_survived(classes, classes.count()), "vector-filters")
    sizes = written(survived.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "filter-sizes")
    dealt = (
        classes.select("id", "mult", "embedding")
        .join(survived.select("id", "keys", "filters"), "id")
        .select("id", "mult", "embedding", "filters", F.posexplode("keys").alias("place", "key"))
        .join(sizes, "key")
        .withColumn("parts", F.ceil(F.col("size") / GROUP).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
        .selectExpr("key", "p", "q", "part", "id", "mult", "substring(filters, 1, 8 * place) AS filters", "embedding")  # those below key
    )
    key = ["key", "p", "q"]
    found = written(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(threshold), "a bigint, b bigint, n bigint"), "vector-links")
    discard(survived, sizes)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = (
        classes.select("id", "k1", "k2", "rep", "mult")
        .join(roots, F.col("id") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "id"))
        .select("id", "k1", "k2", "rep", "mult", "root")
    )
    least = written(named.groupBy("root").agg(F.min("rep").alias("component")), "least-vectors")
    named = named.join(least, "root").join(counts, "id", "left").select("k1", "k2", "mult", "component", F.coalesce("n", F.lit(0)).alias("n"))
    joined = base.select("vec", "usable", "k1", "k2").join(named.withColumn("usable", F.lit(True)), ["k1", "k2", "usable"], "left")
    component = F.coalesce("component", "vec")
    null = lambda c: F.when(c != NULL_ID, c)
    return joined.select(
        null(F.col("vec")).alias("vec_id"),
        F.coalesce(F.col("n") + F.col("mult") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        null(component).alias("component_id"),
        (F.col("vec") == component).alias("kept"),
    )

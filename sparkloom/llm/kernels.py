"""Vectorised text kernels over Arrow string buffers.

A kernel looks at the raw UTF-8 bytes of a whole slice of texts at once, so that
cutting into words and hashing them costs a few array passes per byte instead of a
Python object per word.  Slices are bounded by ``SLICE_BYTES`` (one text may exceed
it; its arrays then grow with that text alone).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 20

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(salt)
        return mix64(base) | U64(1)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower_table()
_BYTE_CODE = seeds(256, 7)[LOWER]
_BASE = int(seeds(1, 11)[0]) & ~7 | 3
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n positions at least."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(SEGMENT_BYTES + 1, n).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table, filled, step = np.ones(size, np.uint64), 1, base
            while filled < size:
                table[filled : 2 * filled] = table[:filled] * U64(step)
                filled, step = 2 * filled, step * step & _MASK
            _powers[name] = table
    return _powers["up"], _powers["down"]


def byte_class(word: bytes | None = None, space: bytes | None = None) -> np.ndarray:
    """For each byte 1 if it belongs to words, else 0; every byte from 0x80 on does."""
    mask = np.zeros(256, np.uint8)
    mask[0x80:] = 1
    if space is not None:
        mask[:] = 1
        mask[list(space)] = 0
    if word is not None:
        mask[list(word)] = 1
    return mask


#: Words of the contamination rule: digits, ASCII letters, everything beyond ASCII.
ALNUM = byte_class(word=b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Words between ASCII white space.
SPACED = byte_class(space=b"\x20\x09\x0a\x0b\x0c\x0d")
#: As SPACED, but a word ends where alphanumerics and other characters meet.
TOKENS = np.where(SPACED, 2 - ALNUM, 0).astype(np.uint8)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding at most ``most`` bytes, or one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of rows lo..hi: hash, first byte, byte after the last, and where each row begins.

    member holds the class of each byte; a word is a longest run of one class but 0.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, member: np.ndarray):
        own = offsets[lo : hi + 1]
        first, last = int(own[0]), int(own[-1])
        hashes, starts, ends, at = [], [], [], first
        while at < last:
            to = self._cut(raw, at, min(at + SEGMENT_BYTES, last), last, own, member)
            h, s, e = _segment(raw, at, to, own, member)
            hashes.append(h)
            starts.append(s)
            ends.append(e)
            at = to
        empty = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if starts else empty
        self.end = np.concatenate(ends) if ends else empty
        self.begin = np.searchsorted(self.start, own, side="left")
        self.count = np.diff(self.begin)

    @staticmethod
    def _cut(raw, at, to, last, own, member) -> int:
        """A place at or before ``to`` where no word is cut; after it if one word is that long."""
        if to >= last:
            return last
        back = max(at + 1, to - 4096)
        free = np.flatnonzero(member[raw[back:to]] == 0)
        if len(free):
            return back + int(free[-1])
        row = own[np.searchsorted(own, to, side="right") - 1]
        if row > at:
            return int(row)
        while to < last:
            free = np.flatnonzero(member[raw[to : to + SEGMENT_BYTES]] == 0)
            if len(free):
                return to + int(free[0])
            to = min(to + SEGMENT_BYTES, last)
        return last

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def after(self) -> np.ndarray:
        """For each word, the number of words from it to its row's end, itself included."""
        return np.repeat(self.begin[1:], self.count) - np.arange(len(self.hash))

    def place(self) -> np.ndarray:
        """For each word, its number within its row."""
        return np.arange(len(self.hash)) - np.repeat(self.begin[:-1], self.count)


def _segment(raw, at, to, own, member):
    part = raw[at:to]
    inside = member[part]
    n = len(part)
    edge = np.zeros(n + 1, bool)
    a, b = np.searchsorted(own, at, side="left"), np.searchsorted(own, to, side="right")
    edge[own[a:b] - at] = True
    edge[0] = edge[n] = True
    before = np.zeros(n + 1, np.uint8)
    before[1:] = inside
    here = np.zeros(n + 1, np.uint8)
    here[:n] = inside
    edge |= before != here
    start = np.flatnonzero(edge & (here > 0))
    end = np.flatnonzero(edge & (before > 0))
    up, down = _power_table(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[part] * up[:n], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return mix64(value + (end - start).astype(np.uint64)), start + at, end + at


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the k items from each place on; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by = seeds(k, 1000 + salt)
    out = hashes[:n] * by[0]
    for j in range(1, k):
        out += hashes[j : j + n] * by[j]
    return mix64(out)


def runs_at(hashes: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """runs() of the places in at only."""
    by = seeds(k, 1000 + salt)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += hashes[at + j] * by[j]
    return mix64(out)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin in sorted keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i] .. starts[i] + counts[i] - 1."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts.astype(np.int64), counts)

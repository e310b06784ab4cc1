"""Sum-of-squares online packing of tokenised documents into windows of WIDTH tokens.

Every document is tokenised whole and ended with token END.  Its full windows stand
alone; the rest is placed into the open fill level that minimises the sum of squared
counts of partially filled windows, kept in an array by level (ties: the fullest).
No document is cut otherwise while it is placed.  At a task's end the open windows
are poured together: their pieces, fullest windows first, fill windows of WIDTH, cut
where one ends.  Beyond MOST_OPEN open windows the fullest eighth of them is poured,
what doesn't fill a window stays open, and the other levels stay as they are.  What
is left at a task's end is cut at powers of two (its binary digits), so no sequence
needs padding.

Each task packs what it reads: one map pass, no shuffle, memory bounded by MOST_OPEN
windows.  sequence_id holds the task's number in its high bits.

Tokenising goes through a cache of the pieces that the tokenizer itself cuts a text
into before it merges, so the ids are exactly its own.

Defined results: a null text counts as empty and yields its END alone; repeated rows
are packed each; a null doc_id stays null; extra columns are not read; an empty table
yields nothing.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 4096
END = 2
#: at most 64 MB of ids
MOST_OPEN = 4096
CACHE_ENTRIES = 250_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(last: int = 0x250):
    """Pattern of the tokenizer's pieces in lower-cased text of code points below last, from their categories."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "space": []}
    for code in range(last):
        c = chr(code)
        kind = "space" if c in "\t\n\v\f\r \x85\xa0" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind].append(re.escape(c))
    letter, digit, space = ("".join(kinds[k]) for k in ("L", "N", "space"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+")


PIECES = _pieces()
PLAIN = re.compile(r"[\x00-\u024f]*\Z")


class ChunkTokenizer:
    """Token ids, as little-endian 32-bit bytes, from cached encodings of parts of a text.

    Texts of code points below U+0250 (no character there composes with another) are
    lower-cased and cut into the tokenizer's own pieces; others are cut at blanks and
    line feeds only.  Texts that hold a special token's name go to the tokenizer whole.
    The cache has two generations of ``entries`` parts each.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if "<|" in text:
            return self._ids(self.tokenizer.encode(text, add_special_tokens=False))
        plain = text.isascii() or PLAIN.match(text) is not None
        parts = PIECES.findall(text.lower()) if plain else text.replace("\n", " ").split(" ")
        cache = self.cache
        try:
            return b"".join([cache[c] for c in parts])
        except KeyError:
            pass
        missing = {c for c in parts if c not in cache}
        if len(cache) + len(missing) > self.entries:
            self.older, self.cache = cache, {"": b""}
            cache, missing = self.cache, {*parts} - {""}
        new = []
        for c in missing:
            held = self.older.get(c)
            if held is None:
                new.append(c)
            else:
                cache[c] = held
        if not (plain and self._together(new)):
            for c, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                cache[c] = self._ids(e)
        return b"".join([cache[c] for c in parts])

    def _together(self, pieces: list[str]) -> bool:
        """Encode pieces as one text, apart by blanks, and cut the ids where pieces end."""
        if not pieces:
            return True
        raw = self._ids(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0])
        at = np.flatnonzero(self.ends[np.frombuffer(raw, np.uint32)]) + 1
        if len(at) != len(pieces) or at[-1] * 4 != len(raw):
            return False
        last, cache = 0, self.cache
        for piece, to in zip(pieces, (at * 4).tolist(), strict=True):
            cache[piece] = raw[last:to]
            last = to
        return True

    @staticmethod
    def _ids(encoding) -> bytes:
        return array("I", encoding.ids).tobytes()


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> ChunkTokenizer:
    """One for all tasks of a worker process."""
    return ChunkTokenizer(path)


class Packer:
    """Pieces are (doc, start, ids as bytes, tokens of the document); put() and close() emit rows."""

    def __init__(self, base: int, emit: Callable[[tuple], None], width: int = WIDTH, most_open: int = MOST_OPEN):
        self.width, self.most_open, self.emit, self.next = width, most_open, emit, base
        self.count = np.zeros(width + 1, np.int64)
        self.level: dict[int, list[list]] = {}
        self.open = 0

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.emit((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def put(self, doc, ids: bytes) -> None:
        total, full = len(ids) // 4, 4 * self.width
        start = 0
        while len(ids) - 4 * start >= full:
            self._close([(doc, start, ids[4 * start : 4 * start + full], total)])
            start += self.width
        rest = total - start
        if rest:
            self._place(rest, (doc, start, ids[4 * start :], total))

    def _place(self, size: int, piece: tuple) -> None:
        # change of the sum of squares when a window goes from level h to h + size
        room = self.width - size
        change = 2 * (self.count[size : self.width + 1] - self.count[: room + 1]) + 2
        change[0] = 2 * self.count[size] + 1
        change[room] = 1 - 2 * self.count[room] if room else 0
        usable = self.count[: room + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        h = room - int(change[::-1].argmin())
        window = self._take(h) if h else []
        window.append(piece)
        if h + size == self.width:
            self._close(window)
        else:
            self._add(h + size, window)
        if self.open > self.most_open:
            self._pour(False)

    def _take(self, h: int) -> list:
        self.count[h] -= 1
        self.open -= 1
        return self.level[h].pop()

    def _add(self, h: int, window: list) -> None:
        self.count[h] += 1
        self.open += 1
        self.level.setdefault(h, []).append(window)

    def _pour(self, last: bool) -> None:
        """Full windows from the pieces of the fullest open ones, or of all; the rest stays open, or is cut at powers of two."""
        pieces, least = [], 0 if last else self.most_open - max(1, self.most_open // 8)
        for h in np.flatnonzero(self.count)[::-1].tolist():
            while self.count[h] and self.open > least:
                pieces += self._take(h)
        left = sum(len(p[2]) // 4 for p in pieces)
        window, room = [], 0
        for doc, start, ids, total in pieces:
            while ids:
                if not room:
                    room = self.width if left >= self.width else (1 << (left.bit_length() - 1) if last else self.width)
                part = ids[: 4 * room]
                n = len(part) // 4
                window.append((doc, start, part, total))
                ids, start, room, left = ids[4 * room :], start + n, room - n, left - n
                if not room:
                    self._close(window)
                    window = []
        if window:
            self._add(self.width - room, window)

    def close(self) -> None:
        self._pour(True)


def packed(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, end: int = END) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    path = tokenizer or default_tokenizer()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = tokenizer_of(path), []
        packer = Packer(TaskContext.get().partitionId() << 40, rows.append, width)
        tail = np.array([end], "<u4").tobytes()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.put(doc, encode(text.as_py() or "") + tail)
            yield batch_of()
        packer.close()
        yield batch_of()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(kernel, SCHEMA)

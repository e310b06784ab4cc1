"""Conversations without quotations, linked by what they quote.

A line's quote level is the number of ``>`` (blanks between allowed) it starts with.
A passage is a run of lines of one level; its blanks are squeezed and A-Z lower-cased
for hashing.  Passages are hashed whole, by paragraph and by line, so that a trimmed
quote, one answered paragraph by paragraph and one whose blank lines lack ``>`` are
found too.  Quoted pieces are joined, by hash, to the messages that hold them as a
piece of their own (level 0); the latest earlier message of the same conversation
wins, so a reply to a reply links to the right one.  Of a message's pieces the least
level counts, of that the whole passage before paragraphs and these before lines,
and of parts the message that holds most characters of them.  Parts have at least
MIN_CHARS characters; a whole passage may be shorter inside a conversation.  Where no
earlier message of the conversation holds a piece, the earliest in another
conversation is named as foreign.

Messages are returned in reply order, each with its own words only, its parent turn
(the quoted message of the least level, else the turn before) and its depth of quotes.
``position`` is the place in the reply tree read depth first: a message comes after the
one it quotes, or after the one before it; answers to one message come by (turn, role,
place in the table).

Scale: texts are parsed in one linear Arrow pass and written without their quotations;
a second pass hashes the pieces of originals, and only those that are quoted somewhere
are shuffled (a semi-join against the quoted hashes, a written table whose size the
planner knows).  No quotation anywhere ends the work there.  Latest earlier originals
and places in a conversation come from range-partitioned sorts, so that a conversation
or a passage of a third of all messages is spread over tasks.  Foreign originals are
reduced to one a hash before the join.

Defined results: null text is an empty message; null conv_id, turn: grouped as their
own values, compared null-safe; repeated rows stay repeated; an unmatched quotation
leaves parent turn as the turn before; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import reply_order, sorted_runs
from sparkloom.llm.common import written

MIN_CHARS = 8
_PARAGRAPH = re.compile(r"\n(?:[ \t\r]*\n)+")
_QUOTED = re.compile(r"^[ \t]*>", re.MULTILINE)
_BLANKS = re.compile(r"[ \t\r\n]+")
BATCH_BYTES = 4 << 20

Piece = tuple[bytes, int, int]  # hash, rank (0 whole, 1 paragraph, 2 line), characters


def level_of(line: str) -> tuple[int, str]:
    """Quote level and what follows the marks and one blank."""
    at = level = place = 0
    while at < len(line) and line[at] in " \t>":
        if line[at] == ">":
            level, place = level + 1, at + 1
        at += 1
    return level, line[place + 1 :] if line[place : place + 1] in (" ", "\t") else line[place:]


def passages(text: str) -> list[tuple[int, str]]:
    """(level, body) of each run of lines of one level."""
    if not _QUOTED.search(text):
        return [(0, text)]
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        level, body = level_of(line)
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(lines)) for level, lines in out]


def pieces(body: str, min_chars: int) -> Iterator[Piece]:
    """A passage whole, by paragraph and by line, hashed."""
    cuts = [(0, [body])]
    if "\n" in body:
        cuts += [(1, _PARAGRAPH.split(body)), (2, body.split("\n"))]
    for rank, parts in cuts:
        for part in parts:
            held = _BLANKS.sub(" ", part).strip(" ")
            if len(held) >= min_chars or rank == 0 and held:
                yield hashlib.md5(held.encode().lower()).digest(), rank, len(held)  # bytes: A-Z alone become lower case


def own_words(parts: list[tuple[int, str]]) -> str:
    return "\n".join(body.strip(" \n") for level, body in parts if level == 0).strip(" \n")


MESSAGE = "conv_id bigint, turn bigint, role string, text string, n_quoted bigint, max_level bigint, quoted array<struct<hash:binary,level:int,rank:int,n_chars:bigint>>"
_QUOTED_TYPE = pa.list_(pa.struct([("hash", pa.binary()), ("level", pa.int32()), ("rank", pa.int32()), ("n_chars", pa.int64())]))


def _parse(min_chars: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, levels, held = [], [], [], []
            for value in batch.column(3):
                parts = passages(value.as_py() or "")
                texts.append(own_words(parts))
                counts.append(sum(level > 0 for level, _ in parts))
                levels.append(max(level for level, _ in parts))
                held.append([{"hash": h, "level": level, "rank": rank, "n_chars": n} for level, body in parts if level for h, rank, n in pieces(body, min_chars)])
            columns = [batch.column(i) for i in range(3)] + [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(levels, pa.int64()), pa.array(held, _QUOTED_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "n_quoted", "max_level", "quoted"])

    return kernel


def _originals(min_chars: int):
    """conv_id, turn and hash of every piece of a message's own words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, size = [], [], 0
            for i, value in enumerate(batch.column(2)):
                text = value.as_py() or ""
                found = {h for level, body in passages(text) if not level for h, _, _ in pieces(body, min_chars)}
                rows += [i] * len(found)
                hashes += found
                size += len(text)
                if size > BATCH_BYTES:
                    yield _taken(batch, rows, hashes)
                    rows, hashes, size = [], [], 0
            yield _taken(batch, rows, hashes)

    return kernel


def _taken(batch: pa.RecordBatch, rows: list[int], hashes: list[bytes]) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes, pa.binary())], names=["conv_id", "turn", "hash"])


def _inside(quoted: DataFrame, held: DataFrame) -> DataFrame:
    """id, __parent: the turn that each message quotes, if it is an earlier one of its conversation."""
    asked = quoted.select("conv_id", "turn", "hash", "piece", F.lit(None).cast("bigint").alias("o_turn"))
    given = held.distinct().select("conv_id", "turn", "hash", F.lit(None).cast("bigint").alias("piece"), F.col("turn").alias("o_turn"))
    both = asked.union(given).withColumnRenamed("piece", "id").withColumn("given", F.col("o_turn").isNotNull())
    found = sorted_runs.numbered(both, ["conv_id", "hash"], ["turn", "given", "id"], "o_turn").where("id IS NOT NULL AND last IS NOT NULL")
    met = quoted.join(found.select(F.col("id").alias("piece"), F.col("last").alias("found")), "piece").where(F.col("found") < F.col("turn"))
    best = F.struct((-F.col("level")).alias("l"), (-F.col("rank")).alias("r"), "n", F.col("found").alias("f"))
    return (
        met.groupBy("id", "level", "rank", "found")
        .agg(F.when(F.col("rank") > 0, F.sum("n_chars")).otherwise(F.lit(0)).alias("n"))
        .groupBy("id")
        .agg(F.max_by("found", best).alias("__parent"))
    )


def _foreign(quoted: DataFrame, held: DataFrame, min_chars: int) -> DataFrame:
    """id, __foreign: another conversation that holds what a message quotes, the first in the least rank."""
    first = written(held.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("o")).select("hash", F.col("o.conv_id").alias("o_conv")), "first-originals")
    met = quoted.where(F.col("n_chars") >= min_chars).join(first, "hash").where(~F.col("o_conv").eqNullSafe(F.col("conv_id")))
    return met.groupBy("id").agg(F.min(F.struct("rank", F.col("o_conv").alias("conv"))).alias("least")).select("id", F.col("least.conv").alias("__foreign"))


def _in_reply_order(out: DataFrame, messages: DataFrame, places: DataFrame, inside: DataFrame) -> DataFrame:
    """out with the places of branching conversations replaced by those in their reply trees."""
    conv = F.xxhash64("conv_id", F.col("conv_id").isNull())
    placed = messages.select("id", conv.alias("conv"), "turn").join(places.select("id", "place"), "id")
    found = written(reply_order.jumps(placed, inside.select("id", F.col("__parent").alias("parent"))), "jumps")
    if found.isEmpty():
        return out
    return out.join(reply_order.positions(placed, found), "id", "left").withColumn("place", F.coalesce("position", "place")).drop("position")


def linked(conversations: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """conv_id, turn, role, text (own words), n_quoted, max_level, parent_turn, linked, foreign_conv, position."""
    base = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.make_valid_utf8(F.col("text").cast("string")).alias("text"),
    )
    # numbered once, when written, so that a row's id is the same in every job
    messages = written(base.mapInArrow(_parse(min_chars), MESSAGE).withColumn("id", F.monotonically_increasing_id()), "messages")
    places = sorted_runs.numbered(messages.select("id", "conv_id", "turn", "role"), ["conv_id"], ["turn", "role", "id"], "turn")
    out = messages.join(places.withColumnRenamed("last", "__before"), "id")
    quoted = written(messages.where("size(quoted) > 0").select("id", "conv_id", "turn", F.inline("quoted")).withColumn("piece", F.monotonically_increasing_id()), "quoted")
    if quoted.isEmpty():
        out = out.withColumns({"__parent": F.lit(None).cast("bigint"), "__foreign": F.lit(None).cast("bigint")})
    else:
        wanted = written(quoted.select("hash").distinct(), "quoted-hashes")
        held = base.select("conv_id", "turn", "text").mapInArrow(_originals(min_chars), "conv_id bigint, turn bigint, hash binary")
        held = written(held.join(wanted, "hash", "left_semi"), "originals")
        inside = written(_inside(quoted, held), "answers")
        out = out.join(inside, "id", "left").join(_foreign(quoted, held, min_chars), "id", "left")
        out = _in_reply_order(out, messages, places, inside)
    return out.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n_quoted",
        "max_level",
        F.coalesce("__parent", "__before").alias("parent_turn"),
        F.col("__parent").isNotNull().alias("linked"),
        F.when(F.col("__parent").isNull(), F.col("__foreign")).alias("foreign_conv"),
        F.col("place").alias("position"),
    )

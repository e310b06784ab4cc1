"""The order in which a conversation's messages are read when replies follow what they answer.

A message answers the one it quotes, else the one before it; a conversation is then a
tree, read depth first, answers to one message in their own order.  Messages that
answer the one before form segments, so that only quotations further back ("jumps")
matter: a segment is read as a whole, then the segments that jump into it, from its
end to its start.

Nothing here holds a conversation in one task: segments are linked to a list in reading
order, whose places come from pointer jumping, in as many rounds as the logarithm of the
segments of the largest conversation.  Conversations without a jump aren't touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import sorted_runs
from sparkloom.llm.common import discard, written


def jumps(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """id, conv, place, attach: messages that answer another than the one before them.

    messages: id, conv (a non-null key), turn, place; answers: id, parent (a turn).  Of
    several messages of a turn the last is answered.
    """
    last = messages.groupBy("conv", F.col("turn").alias("parent")).agg(F.max("place").alias("attach"))
    met = answers.join(messages.select("id", "conv", "place"), "id").join(last, ["conv", "parent"])
    return met.where(F.col("attach") != F.col("place") - 1).select("id", "conv", "place", "attach")


def _ranked(nodes: DataFrame) -> DataFrame:
    """node, after: the weights from a node to the end of its list; nodes: node, next, weight."""
    now = written(nodes.select("node", "next", F.col("weight").alias("after")), "tour")
    while not now.where("next IS NOT NULL").isEmpty():
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("after").alias("more"))
        open_ = now.where("next IS NOT NULL").join(ahead, "next").select("node", F.col("beyond").alias("next"), (F.col("after") + F.col("more")).alias("after"))
        last, now = now, written(open_.unionByName(now.where("next IS NULL")), "tour")
        discard(last, collect=False)
    return now.select("node", "after")


def positions(messages: DataFrame, found: DataFrame) -> DataFrame:
    """id, position of every message of the conversations that jumps() found."""
    branched = messages.join(found.select("conv").distinct(), "conv", "left_semi").join(found.select("id", "attach"), "id", "left")
    branched = written(branched.withColumn("own", F.when(F.col("attach").isNotNull() | (F.col("place") == 1), F.col("id"))), "branched")
    # each message's segment, named by the message that it begins with
    runs = sorted_runs.numbered(branched.select("id", "conv", "place", "own"), ["conv"], ["place"], "own")
    placed = branched.join(runs.select("id", F.col("last").alias("earlier")), "id").withColumn("segment", F.coalesce("own", "earlier"))
    placed = written(placed.select("id", "conv", "place", "attach", "segment"), "segments")
    size = placed.groupBy("segment").agg(F.count("*").alias("size"), F.min("place").alias("start"), F.max("attach").alias("attach"), F.first("conv").alias("conv"))
    at = placed.select("conv", F.col("place").alias("attach"), F.col("segment").alias("into"))
    segments = written(size.join(at, ["conv", "attach"], "left"), "segment-tree")
    # children of a segment from its end to its start, at one message in their own order: the next one is the last before it in the opposite order
    children = segments.where("into IS NOT NULL")
    beside = sorted_runs.numbered(
        children.select(F.col("segment").alias("id"), "into", "attach", (-F.col("start")).alias("back"), "segment"), ["into"], ["attach", "back"], "segment"
    ).select(F.col("id").alias("segment"), F.col("last").alias("sibling"))
    first = children.groupBy("into").agg(F.min(F.struct((-F.col("attach")).alias("a"), "start", "segment")).alias("c")).select(F.col("into").alias("segment"), F.col("c.segment").alias("child"))
    tree = segments.join(beside, "segment", "left").join(first, "segment", "left")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    down = F.struct(enter("segment").alias("node"), F.coalesce(enter("child"), leave("segment")).alias("next"), F.col("size").alias("weight"))
    up = F.struct(leave("segment").alias("node"), F.coalesce(enter("sibling"), leave("into")).alias("next"), F.lit(0).cast("bigint").alias("weight"))
    after = _ranked(tree.select(F.inline(F.array(down, up))))
    total = placed.groupBy("conv").agg(F.count("*").alias("total"))
    begin = segments.select("segment", "start", "conv").join(after, F.col("segment") * 2 == F.col("node")).join(total, "conv")
    begin = written(begin.select("segment", "start", (F.col("total") - F.col("after")).alias("before")), "segment-places")
    return placed.join(begin, "segment").select("id", (F.col("before") + F.col("place") - F.col("start") + 1).alias("position"))

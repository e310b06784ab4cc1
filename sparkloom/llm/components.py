"""Connected components of links, by alternating large and small stars.

Links are undirected pairs of 64-bit ids.  A large star links every greater neighbour
of a node to the least of its neighbourhood, a small star every lesser one; after
O(log^2 n) rounds each component is a star around its least id.  Every round is two
aggregations and joins on the node.  The aggregates are written, so that a join reads
two plain tables and AQE can split a hot node (or broadcast a small table by its size);
so are rounds: lineage stays short and a lost executor costs one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b) with a > b; written."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")), "least-neighbours")
    if large:
        joined = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # what has no lesser neighbour keeps its link through the greater ends
        return _settled(joined.distinct(), least)
    joined = edges.join(least, F.col("a") == F.col("node")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return _settled(joined.where("a <> b").distinct(), least)


def _settled(edges: DataFrame, least: DataFrame) -> DataFrame:
    out = written(edges, "edges")
    discard(least, collect=False)
    return out


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least id of its component) of every node that has a link."""
    edges = links.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).where("a <> b").distinct()
    edges, before = written(edges, "edges"), None
    for _ in range(most_rounds):
        last, large = edges, _star(edges, True)
        edges = _star(large, False)
        discard(last, large, collect=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

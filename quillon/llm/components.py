"""Connected components by alternating large and small stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._work import discard, stash

#: A node with more than this share of all edges, and more than so many, is a hub; its edges are dealt over so many parts.
HUB_SHARE, HUB_EDGES, PARTS = 1 / 500, 1000, 256


def _with_least(rows: DataFrame, edges: int) -> DataFrame:
    """``rows`` (x, y) with m, the smallest y of each x.

    Hubs are at most 2 / HUB_SHARE, so that they are broadcast whatever the number of edges is; their rows are
    dealt by y, and their smallest is copied to each part.
    """
    many = F.col("n") > max(int(edges * HUB_SHARE), HUB_EDGES)
    least = rows.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.filter(many).select(F.col("k").alias("hub")))
    dealt = rows.join(hubs, F.col("x") == F.col("hub"), "left")
    dealt = dealt.select("x", "y", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("y"), F.lit(PARTS))).otherwise(0).cast("int").alias("part"))
    copies = least.select("k", "m", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("p"))
    return dealt.join(copies, (F.col("x") == F.col("k")) & (F.col("part") == F.col("p"))).select("x", "y", "m")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, for all ids on ``edges`` (a, b) but components' own smallest.

    Rows with nulls and loops are left aside, repeated ones count once; no edges give no rows. Every round joins
    edges with the smallest neighbour of each node, so no node's neighbours are ever gathered; rounds grow with
    the logarithm of the longest chain.
    """
    a, b = F.col("a"), F.col("b")
    table = stash(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return table.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = new
        # Large star: every larger neighbour of a node goes to the smallest among the node and its neighbours.
        both = table.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))))
        large = _with_least(both, new[0]).filter(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.least("m", "x").alias("y")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        joined = _with_least(large, new[0])
        small = joined.select(F.inline(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("y").alias("u"), F.col("m").alias("v"))))).filter(F.col("u") != F.col("v")).distinct()
        last, table = table, stash(small, "edges")
        discard(last)

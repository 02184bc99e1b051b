"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of longs to ``(node, root)``, root being the smallest node reachable; nodes without links are absent.

    Each round points nodes at the smallest neighbour known and is written out, so the plan stays short and a
    lost executor costs one round at most; the number of rounds grows with the logarithm of the longest chain.
    A node with very many links is a join key that adaptive execution can split; its minimum is a partial aggregate.
    """
    e = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = saved(e, "links")
    last = None
    for _ in range(ROUNDS):
        # large star: larger neighbours point at the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node and its smaller neighbours point at the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = saved(moved.filter("u <> v").distinct(), "links")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")

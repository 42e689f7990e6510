"""Connected components of a table of links, by alternating star contraction.

Each round every node points its larger neighbours, then all its smaller ones,
at the smallest of them; the links shrink to stars around each component's
smallest node. Sums and joins by node only: no component is gathered anywhere.
Nodes that hold more than a thousandth of the links, two thousand at most, are
sent to every task, so that the centre of a large star is no task's alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut

#: A node with more than this share of the links, and more links than CROWD, is joined without dealing its links out.
HOT, CROWD = 1000, 1000


def _stars(links: DataFrame, count: int, large: bool) -> DataFrame:
    """links: a > b. Large: each node's larger neighbours point at its smallest; small: its smaller ones and itself do."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    crowd = max(CROWD, count // HOT)
    hot = F.broadcast(least.filter(F.col("n") > crowd).select("u", "m"))  # 2 * count / crowd rows at most
    near = both.join(hot, "u").unionByName(both.join(hot, "u", "left_anti").join(least.filter(F.col("n") <= crowd).select("u", "m"), "u"))
    if large:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): node and component (its smallest node), for each node that has a link to another."""
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(now)
    while True:
        now = cut(_stars(cut(_stars(now, seen[0], large=True)), seen[0], large=False))
        mark = state(now)
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark

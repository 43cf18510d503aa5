"""Connected components by alternating large-star and small-star steps.

After each pair of steps the edges are written to the shared folder and those
of the pair before are deleted; the loop ends when a pair changes nothing,
which leaves every node joined to the smallest node it can reach. A node's
smallest neighbour is found by partial aggregation, and joined to its edges in
``SALTS`` parts, so that the centre of a large component isn't one task.

Edge cases: edges in either direction, repeated ones and loops are allowed;
edges with a null end lead nowhere; no edges give no rows; nodes may be of any
type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import erase, written

SALTS = 16


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with their u's m."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(least.hint("merge"), ["u", "salt"]).drop("salt")  # it grows with the links: never a broadcast


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return _beside(both.where(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _beside(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of ``edges`` (u, v) that isn't its component's smallest, that smallest node."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        last, edges = edges, written(_small_star(_large_star(edges)), "edges")
        erase(last)
        now = _sum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

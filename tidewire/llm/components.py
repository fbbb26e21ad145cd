"""Connected components of an edge table, with bounded memory anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import lookup
from .storage import discard, stage


#: Links that one task writes, where there are few.
TOGETHER = 100_000


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return lookup(both.filter("b > a"), low, "a", "n", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = lookup(down, low, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, any order).

    Alternating large-star and small-star steps; each is a pre-aggregated
    minimum and a join that leaves the links of a hub where they are; each round
    is staged in the shared folder, and it stops when a round changes nothing.  Self links and repeats are harmless; no edges
    give no rows.  Component is the smallest node reachable.
    """
    cur = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        now = cur.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        if now[0] == 0 or now == sign:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b"), F.col("b")).distinct())
        sign = now
        # a round never has more links than the one before, so a small one is written by few tasks
        new = stage(_small_star(_large_star(cur, now[0]), now[0]).distinct().coalesce(-(-now[0] // TOGETHER)), "edges")
        discard(cur)
        cur = new
    raise RuntimeError("components did not settle")

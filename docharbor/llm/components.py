"""Connected components by alternating star contractions, each round a pair of joins on grouped minima.

No round gathers a node's neighbours in one task: the minimum of a neighbourhood is a grouped aggregate (combined on the
map side), and sending it to the neighbours is an equi-join that adaptive execution splits where one node has very many.
Rounds are cut from their lineage by a table in the shared folder; older rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 100) -> DataFrame:
    """(src, dst) pairs of one orderable type -> (node, component), component the smallest node that is reachable.

    Nodes without an edge aren't returned. Null ends and loops are ignored. No edges: no rows.
    """
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"), "src", "dst").toDF("a", "b", "_s", "_d")
    e = e.where(F.col("_s").isNotNull() & F.col("_d").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    held, before = Written(e, tag), None
    for _ in range(max_rounds):
        e = held.df
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # each larger neighbour of a now points at the smallest node around a
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # each smaller neighbour of a, and a itself, now points at the smallest of them
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        new = Written(small, tag)
        held.drop()
        held = new
        # pairs can only move towards smaller ends: equal counts and hash sums mean that nothing moved
        now = held.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return held.df.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.df.select("b", "b").distinct())

"""Connected components of an edge table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import release, written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Alternates two contractions: every node's larger neighbours are tied to its smallest neighbour, then its
    smaller ones are. Both keep components whole and the number of rounds grows with the logarithm of
    the longest chain. Rows are small; a hub's edges are combined before the shuffle. Each round is a
    written table, so a lost executor costs one round at most; rows carry a mark of whether they moved, and the first round without
    one is the last. Null ends and loops are left out; no edges give no rows.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
        .where("u > v and not x and not y").select("u", "v").distinct()
    )
    for _ in range(rounds):
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        large = large.groupBy("u", "v").agg(F.max("moved").alias("moved"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the row of the smallest neighbour itself keeps u tied to m
        small = large.join(least, "u").select(
            F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("v") > F.col("m"))).alias("moved")
        )
        now = written(small.groupBy("u", "v").agg(F.max("moved").alias("moved")))
        still = not now.where("moved").isEmpty()
        release(now.sparkSession)
        if not still:
            break
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (node, root): every node of an edge with the smallest node it reaches.

    Each round is joins and min-aggregates; the rounds grow with the logarithm of the
    longest chain.  A hub's rows are split by adaptive skew joins: both join inputs are
    stored tables, and the minima combine before the shuffle.  Loops and repeated edges
    are dropped; an empty table gives an empty result.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    e = store(edges.where(F.col("u") != F.col("v")).select(big.alias("u"), small.alias("v")).distinct())
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = store(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .distinct())
        low = store(large.groupBy("u").agg(F.min("v").alias("m")))
        e = store(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

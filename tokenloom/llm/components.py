"""Connected components by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Steps


def _settled(now: DataFrame) -> bool:
    """Every node has one edge, to a node that has none itself."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(now.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").head(1)


def components(edges: DataFrame, steps: Steps | None = None, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)`` that is not itself its component's smallest node.

    Each round makes two aggregations to a minimum and two joins back on the node, and is written as a table in place of the
    round before. A hub with very many neighbours is only ever aggregated to a minimum or joined with one row. Rows with a
    null end and loops are left out.
    """
    steps = steps or Steps(edges.sparkSession, "components")
    now = steps.keep("round0", edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for k in range(1, rounds + 1):
        if _settled(now):
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(parent.select("u", F.col("m").alias("v")))
        now = steps.keep(f"round{k}", small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        steps.drop(f"round{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))

"""Connected components of an edge table, by alternating large and small stars in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm._common import drop_folder, written

MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge, where root is the least node that it reaches.

    ``edges`` has two columns of one ordered type; direction, repeats, loops and nulls don't matter. Each
    round writes its edges below the shared folder; nothing but two numbers a round comes to the driver.
    A node with very many neighbours is joined on its key as skewed (adaptive execution splits it), and its
    least neighbour is found by partial aggregation.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, folder = written(now, "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, newer = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_folder(edges.sparkSession, folder)
        folder = newer
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

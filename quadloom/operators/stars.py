"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.staging import Staging


def contract(edges: DataFrame, staging: Staging) -> DataFrame:
    """Connects every vertex of the edges (u, v) directly to the least one of its group: (v, root), roots included.

    Every step writes the edges anew, which shrink to one per vertex. No step gathers the neighbours of a vertex: each
    vertex needs the least of them only, which partial aggregates find. Edges of a vertex with itself don't count.
    """
    edges, last = staging.cut(edges.select("u", "v").where("u <> v").distinct()), None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("m").alias("u"), "v").distinct()
        # small star: each vertex's lesser neighbours, and itself, to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), "m")
        small = large.join(low, F.col("v") == F.col("c"))
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        new = staging.cut(small.where("u <> v").distinct())
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        staging.drop(edges)
        edges = new
        if now == last:
            break
        last = now
    return edges.select("v", F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())

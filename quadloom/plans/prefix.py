"""Running sums over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.plans.staging import Staging


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], weight: str, out: str, staging: Staging) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same keys up to and including each row.

    The rows are range-partitioned by keys and order, so that a hot key spreads over many partitions. Sums per
    (partition, key) form a table of at most partitions + keys rows, whose own running sum gives each partition its
    offset. The order should be total; between rows that tie, the order is arbitrary. NULL keys form a group; NULL
    weights count as 0.
    """
    spread = staging.cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    w = F.coalesce(F.col(weight), F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    totals = spread.groupBy("_part", *keys).agg(F.sum(w).alias("_total"))
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    offsets = offsets.select(F.col("_part").alias("_o_part"), *[F.col(k).alias(f"_o_{k}") for k in keys], "_before")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = spread.withColumn("_local", F.sum(w).over(inside))
    on = F.col("_part") == F.col("_o_part")
    for s in same:
        on = on & s
    joined = local.join(offsets, on, "left").withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0)))
    return joined.select(*df.columns, out)

"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are first grouped by key *and* value, so that a hot key spreads over as many reducers as it has values and equal
rows merge before they are shuffled. Distinct counts, modes and percentiles then come from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.plans.prefix import running_sum
from quadloom.plans.staging import Staging


def compress(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row per key and combination of values, with ``_n``, the number of rows that have it."""
    return df.groupBy(key, *values).agg(F.count(F.lit(1)).alias("_n"))


def distinct_profile(df: DataFrame, key: str, values: dict[str, str], n_rows: str = "n_rows", n_tuples: str = "n_tuples") -> DataFrame:
    """For each key: its rows, its distinct combinations of the value columns, and the distinct values of each.

    ``values`` maps a value column to the name of its count. Rows with NULL in the key or a value column don't count
    (a key without other rows is no row of the result); an empty table gives an empty result; repeated rows count in
    ``n_rows`` only. Other columns of ``df`` play no part, whatever their names.

    Two shuffles carry data: one row per distinct combination, then one per distinct (key, column, value) and map task.
    The last one, by key alone, carries one row per key and task.
    """
    cols = list(values)
    have = df.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)]).dropna()
    fine = compress(have, "_k", [f"_v{i}" for i in range(len(cols))])
    sides = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("i"), F.col(f"_v{i}").alias("v")) for i in range(len(cols))]))
    tall = fine.select("_k", "_n", sides.alias("_s")).select("_k", "_n", "_s.i", "_s.v")
    per_value = tall.groupBy("_k", "i", "v").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_t"))
    first = F.col("i") == 0
    return per_value.groupBy("_k").agg(
        F.sum(F.when(first, F.col("_n"))).alias(n_rows),
        F.sum(F.when(first, F.col("_t"))).alias(n_tuples),
        *[F.count(F.when(F.col("i") == i, F.lit(1))).alias(values[c]) for i, c in enumerate(cols)],
    ).withColumnRenamed("_k", key)


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key its most frequent value (``mode``; the least one where several tie) and ``mode_rows``.

    NULL keys and values don't count.
    """
    fine = compress(df.select(F.col(key).alias(key), F.col(value).alias(value)).dropna(), key, [value])
    best = fine.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias("mode"), (-F.col("b.n")).alias("mode_rows"))


def percentiles(df: DataFrame, key: str, value: str, at: Sequence[float], staging: Staging | None = None) -> DataFrame:
    """For each key the exact lower percentiles of its values: the least value with at least that share at or below it.

    One row per key with ``p<percent>`` columns. NULL keys and values don't count. The weighted values are summed up in
    order over range partitions, so that no task sorts all values of a hot key.
    """
    staging = staging or Staging(df.sparkSession, "percentiles")
    fine = compress(df.select(F.col(key).alias(key), F.col(value).alias(value)).dropna(), key, [value])
    summed = running_sum(fine, [key], [value], "_n", "_upto", staging)
    total = summed.groupBy(key).agg(F.max("_upto").alias("_all"))
    ranked = summed.join(total, key)
    name = lambda q: f"p{q * 100:g}".replace(".", "_")
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(F.lit(q) * F.col("_all")), F.col(value))).alias(name(q)) for q in at])


def top_values(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each key with ``n_rows`` and ``rank``; ties by the least value.

    The partial aggregation and Spark's window group limit keep at most ``k`` rows of a key per task before the shuffle.
    """
    fine = compress(df.select(F.col(key).alias(key), F.col(value).alias(value)).dropna(), key, [value])
    w = Window.partitionBy(key).orderBy(F.desc("_n"), F.asc(value))
    return fine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("_n", "n_rows")

"""Transitive closures by rounds of joins, staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.staging import Grown, Staging


def closure(edges: DataFrame, staging: Staging | None = None, keys: list[str] | None = None) -> DataFrame:
    """All pairs (a, b) that a path of one or more edges connects; pairs (a, a) only on cycles.

    Path doubling: every round joins the new pairs with all known ones from both sides, so that a path of length n
    takes log2(n) rounds. ``keys`` are columns, such as a graph, within which paths stay.
    """
    staging = staging or Staging(edges.sparkSession, "closure")
    keys = keys or []
    delta = staging.cut(edges.select(*keys, "a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    all = Grown(delta)
    while True:
        known = all.df
        right = known.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("a").alias("m"), F.col("b").alias("c"))
        left = known.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("a").alias("c"), F.col("b").alias("m"))
        same = lambda x, on: x if not keys else on & _all([F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys])
        ahead = delta.join(right, same(F.col("b") == F.col("m"), F.col("b") == F.col("m"))).select(*keys, "a", F.col("c").alias("b"))
        behind = delta.join(left, same(F.col("a") == F.col("m"), F.col("a") == F.col("m"))).select(*keys, F.col("c").alias("a"), "b")
        found = ahead.unionByName(behind).distinct()
        fresh = staging.cut(_minus(found, known, [*keys, "a", "b"]))
        if not fresh.head(1):
            staging.drop(fresh)
            return known
        all.add(fresh)
        delta = fresh


def reachable(edges: DataFrame, seeds: DataFrame, forward: bool = True, staging: Staging | None = None) -> DataFrame:
    """Pairs (a, b) of a closure of which a (or, backwards, b) is among ``seeds``, a frame with the column ``n``.

    Semi-naive: each round follows the edges from the pairs that the last round found.
    """
    staging = staging or Staging(edges.sparkSession, "reachable")
    a, b = ("a", "b") if forward else ("b", "a")
    e = staging.cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct())
    seeds = seeds.select(F.col("n").alias("s")).where("s IS NOT NULL").distinct()
    delta = staging.cut(seeds.join(e, F.col("s") == F.col("x")).select("s", F.col("y").alias("t")).distinct())
    all = Grown(delta)
    while True:
        known = all.df
        found = delta.join(e, F.col("t") == F.col("x")).select("s", F.col("y").alias("t")).distinct()
        fresh = staging.cut(_minus(found, known, ["s", "t"]))
        if not fresh.head(1):
            staging.drop(fresh)
            return known.select(F.col("s").alias(a), F.col("t").alias(b))
        all.add(fresh)
        delta = fresh


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _minus(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    other = b.select(*[F.col(c).alias(f"m_{c}") for c in cols])
    return a.join(other, _all([F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in cols]), "left_anti")

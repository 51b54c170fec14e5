"""Pairwise matches into groups: rake and compress, solve the core, restore.

Every round strips the vertices of degree one and replaces each chain of vertices of degree two by one edge between its
ends, found by list ranking (pointer doubling). What is left when a round no longer pays is solved by alternating
large-star and small-star steps. The removed vertices then take their labels back in reverse order.

Nodes get dense numbers in the order of their code points, so that the least number of a group is its least node and
the iterations shuffle numbers, not strings. Hot nodes never gather in one task: degrees are partial aggregates, edges
are removed by joins on both ends, and lookups by a hot node are left to the splitting of skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.stars import contract
from quadloom.plans.prefix import running_sum
from quadloom.plans.staging import Grown, Staging

#: A round of stripping and compressing must remove this share of the edges, else the core is solved as it is.
WORTH = 0.1


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _degrees(edges: DataFrame) -> DataFrame:
    """v, deg and its least and greatest neighbour."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("w")), F.struct("v", F.col("u").alias("w")))).alias("x"))
    return ends.select("x.*").groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("w").alias("n1"), F.max("w").alias("n2"))


def _rank_chains(chain: DataFrame, staging: Staging) -> DataFrame:
    """For each vertex of degree two (v, n1, n2): the ends of its chain, t1 <= t2, or, in a closed ring, its least vertex.

    An arc (v, w) leaves the chain vertex v for its neighbour w. Each arc points to the next one, and the pointers
    double in length until they leave the chain. A step reads the arcs that haven't left, and of those that have only the
    ones that were pointed to in the step before: an arc that no pointer meets now is met by no longer one. So short
    chains drop out of the steps that long ones still take. Rings never end; they are what remains when a step ends no
    arc, and they go on doubling until every pointer has seen the whole ring.
    """
    arcs = chain.select("v", F.explode(F.array(F.struct(F.col("n1").alias("w"), F.col("n2").alias("back")), F.struct(F.col("n2").alias("w"), F.col("n1").alias("back")))).alias("x"))
    arcs = arcs.select("v", "x.w")
    nxt = chain.select(F.col("v").alias("c"), "n1", "n2")
    start = arcs.join(nxt, F.col("w") == F.col("c"), "left").select(
        "v", "w", F.when(F.col("c").isNull(), F.col("w")).alias("t"), F.col("c").alias("jv"),
        F.when(F.col("n1") == F.col("v"), F.col("n2")).otherwise(F.col("n1")).alias("jw"),
        F.least("v", "w").alias("m"), F.lit(True).alias("new"),
    )
    state = staging.cut(start)
    steps, left, reach, before = Grown(state), state.where("t IS NULL").count(), 1, None
    while left and not (left == before and reach >= left):
        target = state.select(*[F.col(c).alias(f"o_{c}") for c in ("v", "w", "t", "jv", "jw", "m")])
        met = state.where("t IS NULL").join(target, (F.col("jv") == F.col("o_v")) & (F.col("jw") == F.col("o_w")))
        stepped = F.struct("v", "w", F.col("o_t").alias("t"), F.col("o_jv").alias("jv"), F.col("o_jw").alias("jw"), F.least("m", "o_m").alias("m"), F.lit(True).alias("new"))
        kept = F.when(F.col("o_t").isNotNull(), F.struct(*[F.col(f"o_{c}").alias(c) for c in ("v", "w", "t", "jv", "jw", "m")], F.lit(False).alias("new")))
        state = staging.cut(met.select(F.explode(F.array_compact(F.array(stepped, kept))).alias("x")).select("x.*"))
        before, left, reach = left, state.where("t IS NULL").count(), reach * 2
        steps.add(state)
    ended = steps.df.where("t IS NOT NULL AND new").unionByName(state.where("t IS NULL"))
    both = ended.groupBy("v").agg(F.min("t").alias("t1"), F.max("t").alias("t2"), F.min("m").alias("ring"), F.count("t").alias("ended"))
    return both.select("v", "t1", "t2", F.when(F.col("ended") == 0, F.col("ring")).alias("ring"))


def number_nodes(nodes: DataFrame, staging: Staging) -> DataFrame:
    """node, n: dense numbers from 1 in code point order."""
    return staging.cut(running_sum(nodes.withColumn("_one", F.lit(1).cast("bigint")), [], ["node"], "_one", "n", staging).select("node", "n"))


def group_pairs(pairs: DataFrame, a: str, b: str, node: str = "node", group: str = "group_id", staging: Staging | None = None) -> DataFrame:
    """One row per node of the pairs with the least node (by code point) of all that are linked to it.

    Pairs with a NULL end don't count, and a node that has no other pair is no row. A pair of a node with itself makes
    the node a row, but no link; repeated pairs and both directions are one link. An empty table gives an empty result.
    Other columns play no part, whatever their names. ``a`` and ``b`` are strings.
    """
    staging = staging or Staging(pairs.sparkSession, "components")
    raw = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    links = staging.cut(raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = number_nodes(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), staging)
    na, nb = nodes.select(F.col("node").alias("a"), F.col("n").alias("u")), nodes.select(F.col("node").alias("b"), F.col("n").alias("v"))
    edges = staging.cut(links.where("a <> b").join(na, "a").join(nb, "b").select("u", "v"))
    staging.drop(links)
    removed: list[DataFrame] = []
    n_edges = edges.count()
    while n_edges:
        at_start = n_edges
        # compress chains of vertices of degree two
        chain = staging.cut(_degrees(edges).where("deg = 2").select("v", "n1", "n2"))
        if chain.head(1):
            ranked = staging.cut(_rank_chains(chain, staging))
            out = ranked.select("v", F.coalesce("ring", "t1").alias("parent")).where("v <> parent")
            removed.append(staging.cut(out))
            cut = chain.select("v", F.explode(F.array("n1", "n2")).alias("w")).select(*_pair("v", "w")).distinct()
            short = ranked.where("ring IS NULL AND t1 <> t2").select(F.col("t1").alias("u"), F.col("t2").alias("v"))
            new = staging.cut(edges.join(cut, ["u", "v"], "left_anti").unionByName(short).distinct())
            staging.drop(edges, chain, ranked)
            edges = new
        # strip vertices of degree one; of a lone edge, the greater end
        leaves = _degrees(edges).where("deg = 1").select(F.col("v").alias("leaf"), F.col("n1").alias("to"))
        ends = leaves.groupBy(*_pair("leaf", "to")).agg(F.max("leaf").alias("leaf"))
        ends = staging.cut(ends.select("u", "v", "leaf", F.when(F.col("leaf") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("parent")))
        removed.append(ends.select(F.col("leaf").alias("v"), "parent"))
        new = staging.cut(edges.join(ends.select("u", "v"), ["u", "v"], "left_anti"))
        staging.drop(edges)
        edges, n_edges = new, new.count()
        if n_edges > (1 - WORTH) * at_start:
            break
    # the core, then the removed vertices, last removed first: a parent has its label when its children ask for it
    labels = contract(edges, staging) if n_edges else None
    for gone in reversed(removed):
        if labels is None:
            found = gone.select("v", F.col("parent").alias("root"))
            tops = gone.select(F.col("parent").alias("v"), F.col("parent").alias("root")).distinct()
        else:
            known = labels.select(F.col("v").alias("parent"), "root")
            found = gone.join(known, "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))
            tops = gone.select("parent").distinct().join(known, "parent", "left_anti").select(F.col("parent").alias("v"), F.col("parent").alias("root"))
        new = staging.cut((tops if labels is None else labels.unionByName(tops)).unionByName(found))
        staging.drop(labels)
        labels = new
    everyone = nodes.select("node", F.col("n").alias("v"))
    if labels is None:
        return nodes.select(F.col("node").alias(node), F.col("node").alias(group))
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    named = least.join(everyone, F.col("least") == F.col("v")).select("root", F.col("node").alias("g"))
    whole = labels.join(named, "root").select("v", "g")
    return everyone.join(whole, "v", "left").select(F.col("node").alias(node), F.coalesce("g", "node").alias(group))

"""Mixing sources to target weights by Pfair scheduling.

Every source's copies are cut into blocks of about the same number of tokens. A source of weight w gives its k-th block
the release time floor((k - 1) / w) and the deadline ceil(k / w), and slots go to the released block with the earliest
deadline. At every slot each source then has had its weight of the slots to within less than one block.

Weights are exact fractions. Where they have a short hyperperiod, after which every source is exactly where it began, the
schedule of one hyperperiod serves any number of blocks; else all slots are scheduled, and blocks are made large enough
that there are not more than MOST_SLOTS of them and one for each source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.prefix import running_sum
from quadloom.plans.staging import Staging

#: Most slots that are scheduled, one row of 20 bytes each: bounds the schedule, not the mix.
MOST_SLOTS = 1_000_000


def exact_shares(weights: dict[str, float]) -> dict[str, Fraction]:
    """The weights in proportion, as the decimal fractions that they are written as. Weights that aren't above 0 fall out."""
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items() if w and 0 < w < float("inf")}
    total = sum(exact.values())
    return {s: x / total for s, x in exact.items()}


def parts_of(shares: dict[str, Fraction]) -> dict[str, int]:
    """Whole parts in exactly the ratio of the shares; their sum is the hyperperiod."""
    period = lcm(*(x.denominator for x in shares.values()))
    return {s: int(x * period) for s, x in shares.items()}


def schedule(parts: dict[str, int], blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int, int]]:
    """(source, k, slot), k and slot from 0: earliest deadline first among the released blocks.

    ``blocks`` is how many blocks each source has, those of one hyperperiod unless given. Ties go to the heavier source,
    then to the lesser name.
    """
    period, blocks = sum(parts.values()), blocks if blocks is not None else parts
    waiting = [(0, s, 0) for s in sorted(parts) if blocks[s] > 0]  # (release, source, k)
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while waiting or ready:
        while waiting and (waiting[0][0] <= slot or not ready):
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), -parts[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        yield s, k, slot
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * period // parts[s], s, k + 1))


def quotas_of(shares: dict[str, Fraction], most: dict[str, int], total: int | None = None) -> dict[str, int]:
    """The tokens that each source gives; ``most`` is how many it can give with its repeats.

    Without a total the mix is the largest in which every source keeps its share. With one, a source that can't give its
    share gives all it has, and the others make up for it in proportion to their shares, as far as they can.
    """
    if not shares:
        return {}
    if total is None:
        whole = min(Fraction(most[s]) / x for s, x in shares.items())
        return {s: int(whole * x) for s, x in shares.items()}
    full: dict[str, int] = {}
    while True:
        left, rest = total - sum(full.values()), sum(x for s, x in shares.items() if s not in full)
        want = {s: left * x / rest for s, x in shares.items() if s not in full}
        over = {s: most[s] for s, x in want.items() if x > most[s]}
        if not over:
            return full | {s: int(x) for s, x in want.items()}
        full |= over


def plan_mix(sizes: DataFrame, targets: DataFrame, source: str, tokens: str, share: str, most: str) -> DataFrame:
    """One row per listed source: its target share, how many tokens and documents it has, and whether it can be used.

    A source that is listed twice counts with its least row. One partial aggregate over the documents; the rest has as
    many rows as ``targets``.
    """
    have = sizes.groupBy(F.col(source).alias("_s")).agg(F.sum(tokens).alias("source_tokens"), F.count(F.lit(1)).alias("source_documents"))
    listed = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(F.struct(F.col(share).cast("double").alias("share"), F.col(most).cast("int").alias("most"))).alias("t"))
    rows = listed.join(have, F.col(source) == F.col("_s"), "left").select(
        F.col(source).alias("source"), F.col("t.share").alias("target_share"), F.greatest(F.coalesce("t.most", F.lit(0)), F.lit(0)).alias("max_repeats"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("source_documents", F.lit(0)).alias("source_documents"),
    )
    usable = (F.col("source_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    return rows.withColumn("usable", F.coalesce(usable, F.lit(False)))


def mix_sources(
    documents: DataFrame, targets: DataFrame, key: str, source: str, tokens: str, share: str, most: str, block_tokens: int = 10_000, total_tokens: int | None = None,
    most_slots: int = MOST_SLOTS, staging: Staging | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and the shares it reaches.

    Without ``total_tokens`` the mix is the largest in which every source that has tokens keeps its target share (shares of
    sources without tokens, of NULL or of 0 fall to the others in proportion) and no document is used more than ``most``
    times: the source that is used up first sets the total. With it, the mix has so many tokens, if all sources together
    can give them; sources that can't give their share give all they have, and the others make up for it.

    The first table has a row per use of a document: ``key``, ``source``, ``copy`` (from 1), ``n_tokens``, ``slot`` (of
    its block in the mix) and ``place`` (the running token count within its source, which orders a block). Sorting by
    slot, source and place gives the interleaved collection. Whole passes over a source come first; the last, partial
    pass takes documents in the order of a hash of their key until the source's tokens are reached, to within
    half a document. Documents of unlisted or NULL sources, with NULL keys, and without tokens are no part of a mix.
    A block has ``block_tokens`` tokens, or as many more as ``most_slots`` asks for where weights have no short period.

    The second table has a row per listed source: target and actual share, tokens and documents used, the mean number
    of repeats, and why a target can't be kept (``no documents``, ``not wanted``, ``used up``) or NULL.

    The list of targets is planned on the driver, and the quotas and the schedule are broadcast: a row per source, and at
    most ``most_slots`` and one per source. Running sums per source go over range partitions, as one source may hold most documents.
    """
    staging = staging or Staging(documents.sparkSession, "mixing")
    sizes = documents.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(tokens).cast("bigint").alias("_n"))
    sizes = staging.cut(sizes.where("_key IS NOT NULL AND _source IS NOT NULL AND _n > 0"))
    plan = staging.cut(plan_mix(sizes.select(F.col("_source").alias(source), F.col("_n").alias(tokens)), targets, source, tokens, share, most))
    usable = plan.where("usable").collect()  # as many rows as the list of targets
    shares = exact_shares({r["source"]: r["target_share"] for r in usable})
    quotas = quotas_of(shares, {r["source"]: r["source_tokens"] * r["max_repeats"] for r in usable}, total_tokens)
    quotas = {s: n for s, n in quotas.items() if n > 0}
    parts = parts_of({s: shares[s] for s in quotas}) if total_tokens is None and quotas else {s: n // gcd(*quotas.values()) for s, n in quotas.items()}
    period, blocks = sum(parts.values()), None
    if period > most_slots:
        block_tokens = max(block_tokens, ceil(sum(quotas.values()) / most_slots))
        blocks = {s: n // block_tokens + 2 for s, n in quotas.items()}  # the last document may reach into the next block
    number = {s: i for i, s in enumerate(sorted(parts))}
    ids, ks, slots = zip(*((number[s], k, slot) for s, k, slot in schedule(parts, blocks))) if parts else ((), (), ())
    spark = documents.sparkSession
    as_frame = lambda **columns: spark.createDataFrame(pa.table(columns))
    of_source = as_frame(
        q_source=pa.array(number, pa.string()), q_id=pa.array(number.values(), pa.int64()), q_parts=pa.array([blocks[s] if blocks else parts[s] for s in number], pa.int64()),
        quota=pa.array([quotas[s] for s in number], pa.int64()),
    )
    slots = as_frame(s_at=pa.array([i << 40 | k for i, k in zip(ids, ks)], pa.int64()), s_slot=pa.array(slots, pa.int64()))

    ordered = sizes.join(F.broadcast(of_source), F.col("_source") == F.col("q_source")).withColumn("_h", F.xxhash64(F.col("_key").cast("string")))
    summed = running_sum(ordered, ["_source"], ["_h", "_key"], "_n", "_upto", staging)
    whole = summed.join(F.broadcast(plan.select(F.col("source").alias("p_source"), "source_tokens")), F.col("_source") == F.col("p_source"))
    # pass c (from 0) reaches a document at c * source_tokens + its own running sum
    # and takes it where at least half of it lies within the quota
    middle = F.col("_upto") - F.floor((F.col("_n") + 1) / 2)
    uses = F.when(middle < F.col("quota"), F.floor((F.col("quota") - 1 - middle) / F.col("source_tokens")) + 1).otherwise(F.lit(0)).cast("int")
    copies = whole.withColumn("_uses", uses).where("_uses > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_uses"))))
    copies = copies.withColumn("place", (F.col("_copy") - 1).cast("bigint") * F.col("source_tokens") + F.col("_upto"))
    k = F.floor((F.col("place") - F.col("_n")) / F.lit(block_tokens)).cast("bigint")
    # the k-th block of a source is the (k mod parts)-th of a hyperperiod; where all slots are scheduled, that is the k-th
    placed = copies.withColumn("_block", k).withColumn("_at", F.shiftleft("q_id", 40) + F.col("_block") % F.col("q_parts"))
    placed = placed.join(F.broadcast(slots), F.col("_at") == F.col("s_at"))
    mix = placed.select(
        F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_copy").alias("copy"), F.col("_n").alias("n_tokens"),
        (F.floor(F.col("_block") / F.col("q_parts")) * F.lit(0 if blocks else period) + F.col("s_slot")).cast("bigint").alias("slot"), "place",
    )
    used = copies.groupBy("_source").agg(F.sum("_n").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    everything = used.agg(F.sum("tokens").alias("_all"))
    report = plan.join(used, F.col("source") == F.col("_source"), "left").join(F.broadcast(everything))
    report = report.select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.col("documents") / F.col("source_documents"), F.lit(0.0)).alias("mean_repeats"), "max_repeats",
        F.when(F.col("source_tokens") == 0, F.lit("no documents")).when(~F.col("usable"), F.lit("not wanted"))
        .when(F.lit(total_tokens is not None) & (F.col("source_tokens") * F.col("max_repeats") <= F.col("tokens")), F.lit("used up")).alias("remark"),
    )
    return mix, report

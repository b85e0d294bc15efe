"""Parent chains of any length: who stands above whom, without listing all ancestors of anyone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut, cut_with, release


class Forest(NamedTuple):
    """``jumps[k]``: (entity, up), the entity 2^k parents above; ``nodes``: (entity, depth, top, ring)."""

    jumps: list[DataFrame]
    nodes: DataFrame

    def free(self) -> None:
        for table in (*self.jumps, self.nodes):
            release(table)


def _doubled(links: DataFrame, limit: int) -> tuple[list[DataFrame], bool]:
    """Written rounds of (entity, up, low, steps, top); True if some chain does not end within ``limit`` steps."""
    first = links.select(
        "entity", F.col("parent").alias("up"), F.col("entity").alias("low"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.coalesce("parent", "entity").alias("top"),
    )
    state, seen = cut_with(first, "forest", n=F.count("up"))
    rounds, reach = [state], 1
    while seen["n"] and reach < limit:
        over = state.select(F.col("entity").alias("_at"), *[F.col(c).alias(f"_{c}") for c in ("up", "low", "steps", "top")])
        longer = state.join(over, state["up"] == over["_at"], "left").select(
            "entity", F.col("_up").alias("up"), F.least("low", "_low").alias("low"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_top", "top").alias("top"),
        )
        state, seen = cut_with(longer, "forest", n=F.count("up"))
        rounds.append(state)
        reach *= 2
    return rounds, bool(seen["n"])


def parent_forest(edges: DataFrame) -> Forest:
    """Forest of ``edges`` (entity, parent; null above a root) by pointer doubling: O(log of the longest chain) written rounds.

    An entity given twice keeps its smallest parent; a parent without a row of its own is a root.  A ring is opened above its
    smallest entity, which becomes its top; ``ring`` marks all who stand on one, as everybody who leads there stands below all of them.
    """
    named = edges.filter(F.col("entity").isNotNull()).select("entity", "parent")
    both = named.unionByName(named.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("entity"), F.lit(None).cast("string").alias("parent")))
    links, seen = cut_with(both.groupBy("entity").agg(F.min("parent").alias("parent")), "links", n=F.count(F.lit(1)))
    rounds, endless = _doubled(links, seen["n"])
    ring = None
    if endless:  # 2^k steps are at least as many as there are entities: whoever is reached stands on a ring
        last = rounds[-1]
        on = last.filter(F.col("up").isNotNull()).select(F.col("up").alias("entity")).distinct()
        ring = cut(last.join(on, "entity").select("entity", "low"), "ring")
        for table in rounds:
            release(table)
        opened = links.join(ring.filter(F.col("entity") == F.col("low")).select("entity", F.lit(True).alias("_cut")), "entity", "left")
        rounds, _ = _doubled(opened.select("entity", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent")), seen["n"])
    ends = rounds[-1].select("entity", F.col("steps").alias("depth"), "top")
    if ring is None:
        nodes = cut(ends.withColumn("ring", F.lit(False)), "nodes")
    else:
        nodes = cut(ends.join(ring.select("entity", F.lit(True).alias("ring")), "entity", "left").withColumn("ring", F.coalesce("ring", F.lit(False))), "nodes")
        release(ring)
    release(links)
    return Forest([r.select("entity", "up") for r in rounds], nodes)


def standing_above(pairs: DataFrame, forest: Forest) -> DataFrame:
    """Those of ``pairs`` (low, high) in which high is a parent, or a parent's parent and so on, of low; each pair once.

    Depths say how far to climb; every binary digit of that distance is one equi-join with a table of jumps.
    """
    of = lambda side: forest.nodes.select(F.col("entity").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("depth", "top", "ring")])
    met = pairs.select("low", "high").distinct().join(of("low"), "low").join(of("high"), "high").filter("low_top = high_top")
    climbing = met.filter("high_ring OR low_depth > high_depth").select(
        "low", "high", "high_ring", F.col("low").alias("at"), F.when(F.col("high_ring"), 0).otherwise(F.col("low_depth") - F.col("high_depth")).alias("far")
    )
    for k, jump in enumerate(forest.jumps):
        up = jump.select(F.col("entity").alias("_at"), "up")
        bit = F.shiftright("far", k).bitwiseAND(F.lit(1)) == 1
        climbing = climbing.join(up, F.when(bit, F.col("at")) == F.col("_at"), "left").select(
            "low", "high", "high_ring", F.when(bit, F.col("up")).otherwise(F.col("at")).alias("at"), "far"
        )
    return climbing.filter(F.col("high_ring") | (F.col("at") == F.col("high"))).select("low", "high")

"""Connected components of a large edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.skew import attach_per_key
from newsloom.session import cut_with, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _link(both.filter(F.col("v") > F.col("u")), low)


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    kept = _link(down, low)
    own = low.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return kept.unionByName(own)


def _link(pairs: DataFrame, low: DataFrame) -> DataFrame:
    return attach_per_key(pairs, low, ["u"], "n").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _contract(edges: DataFrame) -> DataFrame:
    return _tidy(_small_star(_tidy(_large_star(edges))))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root): root is the smallest node of the component.

    Star contraction halves path lengths every round, so a chain of n nodes needs O(log n) rounds, and
    no node's neighbourhood is ever gathered: only minima are aggregated and joined back, with hot nodes
    split.  Every round is a written table, so a lost executor costs one round at most.
    """
    marks = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    start = _tidy(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    current, seen = cut_with(start, "components", **marks)
    if seen["n"] == 0:
        return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:  # every round that is not the last lowers some label, so this ends
        following, mark = cut_with(_contract(current), "components", **marks)
        release(current)
        current, same = following, mark == seen
        if same:
            break
        seen = mark
    # Settled edges form stars: every non-root points at its root.
    members = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return members.unionByName(roots)

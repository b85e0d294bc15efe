"""Joins, picks and ranks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from newsloom.session import cut


def equal_keys(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    """Join condition on equal keys, null equal to null; Spark still plans it as an equi-join."""
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]


def attach_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], count_col: str = "", how: str = "left") -> DataFrame:
    """Join one-row-per-key data back to its rows; null keys match null keys.

    A key with a large share of all rows is split over several tasks at run time by the adaptive skew join, which
    ``session.prepare`` enables also where an aggregate follows on the same key.  ``count_col`` is one of the payload
    columns and kept for callers that name it.
    """
    payload = [c for c in per_key.columns if c not in keys]
    side = per_key.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*[F.col(c) for c in payload]).alias("_found"))
    joined = rows.join(side, equal_keys(keys, [f"_k_{k}" for k in keys]), "inner" if how == "inner" else "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.col(f"_found.{c}").alias(c) for c in payload])


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (ascending), as a partial aggregate, not a window."""
    order_struct = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = F.min_by(F.struct(*[F.col(c) for c in payload]), order_struct)
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The k first rows per key.  Spark keeps k rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rank_all(
    rows: DataFrame,
    order: Sequence[Column],
    scope: Sequence[str] = (),
    rank_col: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    """Exact 1-based rank of every row, globally or per scope, by a distributed sort.

    Rows are range-partitioned on (scope, order) and sorted inside partitions, so a scope with a third
    of all rows still spreads over many tasks.  The sorted rows are written once; one count per
    partition (and the first position of each scope) then turns local positions into ranks.
    """
    keys = [F.col(c).asc() for c in scope] + list(order)
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = cut(placed.withColumn("_mid", F.monotonically_increasing_id()), "rank")
    shard = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: bounded by the partition count.
    sizes = placed.groupBy(shard.alias("_shard")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("_shard", "_before")
    placed = placed.withColumn("_shard", shard).join(F.broadcast(before), "_shard")
    placed = placed.withColumn("_pos", F.col("_before") + local)
    if not scope:
        return placed.withColumn(rank_col, F.col("_pos") + 1).drop("_mid", "_shard", "_before", "_pos")
    starts = placed.groupBy(*scope).agg(F.min("_pos").alias("_start"), F.count("*").alias("_scope_n"))
    out = attach_per_key(placed, starts, list(scope), "_scope_n")
    return out.withColumn(rank_col, F.col("_pos") - F.col("_start") + 1).drop(
        "_mid", "_shard", "_before", "_pos", "_start", "_scope_n"
    )


BLOCK_ROWS = 4096
#: Levels of blocks: the last window of a scope sees one row per BLOCK_ROWS ** LEVELS positions.
LEVELS = 3


def _carried(rows: DataFrame, scope: Sequence[str], block: Column, fold, value: Column, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_block``, per block what all earlier blocks of the scope fold to as ``_carry``)."""
    blocked = rows.withColumn("_block", block)
    totals = blocked.groupBy(*scope, "_block").agg(fold(value).alias("_total"))
    if levels <= 1:
        prior = Window.partitionBy(*scope).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return blocked, totals.withColumn("_carry", fold(F.col("_total")).over(prior)).drop("_total")
    inner = totals.withColumnRenamed("_block", "_place")
    outer, carry = _carried(inner, scope, F.floor(F.col("_place") / BLOCK_ROWS), fold, F.col("_total"), levels - 1)
    inside = Window.partitionBy(*scope, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    own = outer.withColumn("_own", fold(F.col("_total")).over(inside))
    joined = _join_blocks(own, carry, scope)
    # Sums add, maxima take the larger; a null on either side is nothing carried.
    both = fold_pair(fold, F.col("_own"), F.col("_carry"))
    return blocked, joined.select(*scope, F.col("_place").alias("_block"), both.alias("_carry"))


def fold_pair(fold, a: Column, b: Column) -> Column:
    if fold is F.max:
        return F.greatest(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _join_blocks(rows: DataFrame, carry: DataFrame, scope: Sequence[str]) -> DataFrame:
    keys = [*scope, "_block"]
    side = carry.select(*[F.col(k).alias(f"_c{k}") for k in keys], "_carry")
    return rows.join(side, equal_keys(keys, [f"_c{k}" for k in keys]), "left").drop(*[f"_c{k}" for k in keys])


def running_sum(rows: DataFrame, scope: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier positions of a scope (0-based dense ``pos``), in levels of blocks."""
    blocked, carry = _carried(rows, scope, F.floor(F.col(pos) / BLOCK_ROWS), F.sum, F.col(value))
    inside = Window.partitionBy(*scope, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_blocks(blocked.withColumn("_in", F.sum(value).over(inside)), carry, scope)
    return joined.withColumn(out, F.coalesce(fold_pair(F.sum, F.col("_in"), F.col("_carry")), F.lit(0))).drop("_block", "_in", "_carry")


def running_max(rows: DataFrame, scope: Sequence[str], pos: str, value: Column, out: str) -> DataFrame:
    """Largest ``value`` at or before each 1-based dense position of a scope, nulls skipped, in levels of blocks."""
    rows = rows.withColumn("_v", value)
    blocked, carry = _carried(rows, scope, F.floor((F.col(pos) - 1) / BLOCK_ROWS), F.max, F.col("_v"))
    inside = Window.partitionBy(*scope, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_blocks(blocked.withColumn("_in", F.max("_v").over(inside)), carry, scope)
    return joined.withColumn(out, F.coalesce("_in", "_carry")).drop("_block", "_v", "_in", "_carry")


def previous_value(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``value`` of the row before, within a scope of any size: ranks, then one join on (scope, rank).

    Also keeps the 1-based rank as ``_rank``.
    """
    ranked = rank_all(rows, order, scope, "_rank")
    keys = [*scope, "_rank"]
    before = ranked.select(*[F.col(k).alias(f"_p{k}") for k in scope], (F.col("_rank") + 1).alias("_p_rank"), F.col(value).alias(out))
    return ranked.join(before, equal_keys(keys, [f"_p{k}" for k in keys]), "left").drop(*[f"_p{k}" for k in keys])

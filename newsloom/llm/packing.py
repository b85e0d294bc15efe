"""Packing by optimal length buckets and token budgets.

One histogram of lengths over all documents is gathered (its number of bins is bounded by the logarithm of the
longest length, not by the data), a dynamic program picks the bucket tops that minimise total padding, and inside
each bucket documents in id order fill batches of ``budget`` padded tokens.

Defined results: null and empty texts have length 0 and share the lowest bucket; a document longer than the budget
gets a batch of its own, marked ``over_budget``; repeated ids are packed as separate rows, ties by length; an empty
table gives no rows.  Null ids sort first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import space_words

BUCKETS = 8
BUDGET = 8192
FINE_BITS = 10
ID_BLOCK = 65_536


def bin_of(length: Column, bits: int = FINE_BITS) -> Column:
    """Lengths under 2**bits have bins of their own; above, every octave has 2**bits / 2 bins at least."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(length)) - (bits + 1))).cast("long")
    return F.floor((length + step - 1) / step) * step


def optimal_tops(counts: np.ndarray, totals: np.ndarray, tops: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket tops (a subset of ``tops``, the last included) with the least padding; ties take the lower cut."""
    n = len(tops)
    c = np.concatenate(([0], np.cumsum(counts)))
    s = np.concatenate(([0], np.cumsum(totals)))
    big = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, big)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, big), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + tops[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        back.append(cut)
    out, j = [], n
    for cut in reversed(back):
        out.append(int(tops[j - 1]))
        j = int(cut[j])
    return out[::-1]


def bucket_tops(lengths: DataFrame, buckets: int = BUCKETS, bits: int = FINE_BITS) -> list[int]:
    """The tops for a frame with a long column ``_len``."""
    rows = (
        lengths.groupBy(bin_of(F.col("_len"), bits).cast("long").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_len").alias("s"), F.max("_len").alias("m"))
        .orderBy("b")
        .collect()
    )
    if not rows:
        return []
    return optimal_tops(*(np.array([r[k] for r in rows], np.int64) for k in ("n", "s", "m")), buckets)


def pack(docs: DataFrame, length: Column | None = None, doc_id: str = "doc_id", budget: int = BUDGET, buckets: int = BUCKETS, bits: int = FINE_BITS) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (from 1), bucket_len, batch (from 0), slot (from 0), over_budget.

    ``length`` defaults to the number of words of ``text``.  Positions inside a bucket come from counts per block of
    ids, so a bucket that holds most documents is still ranked by many tasks.
    """
    length = F.size(space_words(F.col("text"))) if length is None else length
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("_len"))
    tops = bucket_tops(sized, buckets, bits)
    if not tops:
        tops = [0]
    number = F.lit(1)
    for i, top in enumerate(tops[:-1]):
        number = F.when(F.col("_len") > top, i + 2).otherwise(number)
    block = F.floor(F.col("doc_id") / ID_BLOCK)
    placed = sized.select("doc_id", "_len", number.alias("bucket"), block.alias("_block"))
    inside = Window.partitionBy("bucket", "_block").orderBy("doc_id", "_len")
    earlier = Window.partitionBy("bucket").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket", "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col("bucket").alias("_b"), F.col("_block").alias("_k"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_at", F.row_number().over(inside) - 1).join(starts, (F.col("bucket") == F.col("_b")) & F.col("_block").eqNullSafe(F.col("_k")))
    tops_col = F.array(*[F.lit(t).cast("long") for t in tops])
    own = F.element_at(tops_col, F.col("bucket"))
    seats = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), own))).cast("long")
    at = F.col("_before") + F.col("_at")
    return ranked.select(
        "doc_id",
        F.col("_len").alias("n_tokens"),
        F.col("bucket").cast("long").alias("bucket"),
        own.alias("bucket_len"),
        F.floor(at / seats).cast("long").alias("batch"),
        (at % seats).cast("long").alias("slot"),
        (F.col("_len") > budget).alias("over_budget"),
    )


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents),
b AS (SELECT *, (1::BIGINT << greatest(0, length(bin(n)) - {FINE_BITS + 1})::BIGINT) AS step FROM d),
h0 AS (SELECT CAST(floor((n + step - 1) / step) * step AS BIGINT) AS b, count(*) AS c, sum(n) AS s, max(n) AS m FROM b GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY b) AS j, CAST(m AS BIGINT) AS m, CAST(sum(c) OVER (ORDER BY b) AS BIGINT) AS c, CAST(sum(s) OVER (ORDER BY b) AS BIGINT) AS s FROM h0),
e AS (SELECT j, m, c, s FROM h UNION ALL SELECT 0, NULL, 0, 0),
""" + "".join(
    f"""k{k} AS (SELECT h.j, arg_min(p.j, (p.v + h.m * (h.c - p.c) - (h.s - p.s)) * 1000000::HUGEINT + p.j) AS i, min(p.v + h.m * (h.c - p.c) - (h.s - p.s)) AS v
  FROM h JOIN (SELECT e.j, e.c, e.s, {'CASE WHEN e.j = 0 THEN 0 END' if k == 1 else 'q.v'} AS v FROM e {'' if k == 1 else f'JOIN k{k - 1} q USING (j)'}) p ON p.j < h.j AND p.v IS NOT NULL GROUP BY h.j),
"""
    for k in range(1, BUCKETS + 1)
) + f"""last AS (SELECT max(j) AS j FROM h),
kk AS (SELECT least({BUCKETS}, (SELECT j FROM last)) AS k),
allk AS ({' UNION ALL '.join(f'SELECT {k} AS k, j, i FROM k{k}' for k in range(1, BUCKETS + 1))}),
path AS (SELECT kk.k, last.j FROM kk, last UNION ALL SELECT path.k - 1, allk.i FROM path JOIN allk ON allk.k = path.k AND allk.j = path.j WHERE path.k > 1),
tops AS (SELECT path.k AS bucket, h.m AS top FROM path JOIN h USING (j)),
placed AS (SELECT d.doc_id, d.n, (SELECT min(bucket) FROM tops WHERE top >= d.n) AS bucket FROM d),
ranked AS (SELECT placed.*, tops.top, row_number() OVER (PARTITION BY placed.bucket ORDER BY doc_id, n) - 1 AS pos FROM placed JOIN tops USING (bucket))
SELECT doc_id, n AS n_tokens, CAST(bucket AS BIGINT) AS bucket, top AS bucket_len,
  CAST(pos // greatest(1, {BUDGET} // greatest(1, top)) AS BIGINT) AS batch, CAST(pos % greatest(1, {BUDGET} // greatest(1, top)) AS BIGINT) AS slot, n > {BUDGET} AS over_budget
FROM ranked
"""

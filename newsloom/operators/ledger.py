"""Append-only ledgers and attempt logs folded to their current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import times
from newsloom.operators.skew import first_by


def latest_reviews(reviews: DataFrame, seq: str = "seq") -> DataFrame:
    """Last written decision per (event_id, revision); a correction is a later row."""
    payload = [c for c in reviews.columns if c not in ("event_id", "revision")]
    return first_by(reviews, ["event_id", "revision"], [-F.col(seq)], payload)


def approved_keys(reviews: DataFrame, seq: str = "seq") -> DataFrame:
    last = latest_reviews(reviews, seq).filter(F.col("status") == "approved")
    return last.select("event_id", F.col("revision").cast("string").alias("revision"), "content_hash").distinct()


def approved_only(cards: DataFrame, reviews: DataFrame, seq: str = "seq") -> DataFrame:
    """Cards whose exact (event_id, revision as text, content_hash) was approved last."""
    keyed = cards.withColumn("_rev", F.col("revision").cast("string"))
    keys = approved_keys(reviews, seq).withColumnRenamed("revision", "_rev")
    return keyed.join(keys, ["event_id", "_rev", "content_hash"], "left_semi").drop("_rev")


def draft_state(drafts: DataFrame, reviews: DataFrame, seq: str = "seq") -> DataFrame:
    """Current draft per event with the ledgers (``ledger`` labels) that approve exactly it."""
    last = first_by(
        reviews, ["ledger", "event_id", "revision"], [-F.col(seq)], ["content_hash", "status"]
    ).filter(F.col("status") == "approved")
    hits = drafts.select("event_id", "revision", "content_hash").join(
        last.select("ledger", "event_id", "revision", "content_hash"), ["event_id", "revision", "content_hash"]
    )
    labels = hits.select("event_id", "revision", "content_hash", "ledger").distinct().groupBy(
        "event_id", "revision", "content_hash"
    ).agg(F.array_sort(F.collect_list("ledger")).alias("approved_exact_in"))
    return drafts.join(labels, ["event_id", "revision", "content_hash"], "left").withColumn(
        "approved_exact_in", F.coalesce("approved_exact_in", F.array().cast("array<string>"))
    )


def pending_inputs(inputs: DataFrame, completed: DataFrame, keys: tuple[str, str] = ("article_id", "input_hash")) -> DataFrame:
    """Inputs with no stored result for their exact hash."""
    return inputs.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def spend_state(ledger: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest row per request, with a fault for a repeated reservation or settlement."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return ledger.groupBy("request_id").agg(
        F.max_by("kind", seq).alias("kind"),
        F.max_by("charged_usd", seq).alias("charged_usd"),
        F.max_by("usage_unknown", seq).alias("usage_unknown"),
        F.when(n("reserve") > 1, "Duplicate reservation in ledger")
        .when(n("settle") > 1, "Duplicate settlement in ledger")
        .when(F.count_if(~F.col("kind").isin("reserve", "settle")) > 0, "Unknown budget record")
        .alias("fault"),
    )


def spend_summary(state: DataFrame, cap: Column) -> DataFrame:
    charged = F.coalesce(F.sum("charged_usd"), F.lit(0)).cast("decimal(28,6)")
    return state.agg(
        charged.alias("charged_usd"),
        (F.max(cap).cast("decimal(28,6)") - charged).alias("remaining_usd"),
        F.count_if(F.col("kind") == "reserve").alias("unsettled_requests"),
        F.count_if(F.coalesce("usage_unknown", F.lit(False))).alias("unknown_usage_requests"),
        F.count("*").alias("http_attempts"),
        F.count_if(F.col("fault").isNotNull()).alias("faults"),
    )


def last_success(attempts: DataFrame, keys: list[str], at: str = "attempted_at", ok: Column | None = None) -> DataFrame:
    """Last attempt and last successful attempt; a failure keeps the earlier success."""
    ok = ok if ok is not None else F.col("result") != "failed"
    return attempts.groupBy(*keys).agg(
        F.max(at).alias("last_refresh_at"),
        F.max_by("result", at).alias("last_refresh_result"),
        F.max(F.when(ok, F.col(at))).alias("last_success_at"),
    )


def source_freshness(attempts: DataFrame, now: Column, hours: int = 24, keys: list[str] | None = None) -> DataFrame:
    """Last outcome per source, stale when no success lies within the window (never succeeded = stale)."""
    state = last_success(attempts, keys or ["feed"])
    age = times.micros(now) - times.micros("last_success_at")
    return state.withColumn("stale", F.coalesce(age > hours * 3_600_000_000, F.lit(True)))


def latest_day(cards: DataFrame, today: Column, day: str = "date") -> DataFrame:
    """Today's edition when present, else the newest one, with the substitution flagged."""
    has = F.bool_or(F.col(day) == today)
    return cards.agg(F.coalesce(has, F.lit(False)).alias("exact"), F.max(day).alias("newest"), F.max(today).alias("_t")).select(
        F.when(F.col("exact"), F.col("_t")).otherwise(F.col("newest")).alias("day"), "exact"
    )

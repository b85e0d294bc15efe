"""Predictions against analyst labels: one-to-one matching and per-cohort measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators.skew import attach_per_key
from newsloom.session import cut, release


def greedy_pairs(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """Greedy one-to-one matching in the total order ``order`` (ascending), by rounds.

    A pair that is first for both of its sides would be taken by the sequential greedy whatever happens
    elsewhere, so all such pairs are taken at once and every pair touching a used side is dropped; with a
    strict order the result equals the sequential one.  Each round is two partial aggregates and two anti
    joins; no side's candidates are gathered.
    """
    key = F.struct(*order)
    rest = cut(pairs, "pairs")
    taken = []
    while True:  # the first remaining pair of all is mutual, so every round takes one at least
        best_l = rest.groupBy(left).agg(F.min(key).alias("_bl"), F.count("*").alias("_nl"))
        best_r = rest.groupBy(right).agg(F.min(key).alias("_br"), F.count("*").alias("_nr"))
        seen = attach_per_key(attach_per_key(rest, best_l, [left], "_nl"), best_r, [right], "_nr")
        mutual = cut(
            seen.filter((key == F.col("_bl")) & (key == F.col("_br"))).select(*pairs.columns), "matched"
        )
        if mutual.isEmpty():
            break
        taken.append(mutual)
        following = cut(
            rest.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti"), "pairs"
        )
        release(rest)
        rest = following
    out = taken[0] if taken else pairs.limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def gold_events(labels: DataFrame, order: str = "row_no") -> DataFrame:
    """Label rows to gold events: decision of the first row, any must-not-miss, member count.

    Row order is data, so it is a column.
    """
    return labels.groupBy("event_group_id").agg(
        F.min_by("decision", order).alias("decision"),
        F.bool_or(F.col("must_not_miss") == "yes").alias("must_not_miss"),
        F.count("*").alias("articles"),
    )


def shared_articles(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(event_id, event_group_id, shared): labelled articles that a prediction and a gold event share.

    ``members``: event_id, article_id rows.
    """
    return (
        members.select("event_id", "article_id")
        .join(labels.select("article_id", "event_group_id"), "article_id")
        .groupBy("event_id", "event_group_id")
        .agg(F.count("*").alias("shared"))
    )


def match_events(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Greedy match on shared articles, most shared first, ids break ties."""
    pairs = shared_articles(members, labels).withColumn("_o", -F.col("shared"))
    return greedy_pairs(pairs, "event_id", "event_group_id", ["_o", "event_id", "event_group_id"]).drop("_o")


def cluster_errors(members: DataFrame, labels: DataFrame) -> DataFrame:
    """false_merge: a predicted event over several gold events; false_split: a gold event over several."""
    pairs = shared_articles(members, labels)

    def errors(kind, key, other):
        return (
            pairs.groupBy(F.col(key).alias("id"))
            .agg(F.count("*").alias("n"), F.min(other).alias("first_other"), F.max(other).alias("last_other"))
            .filter(F.col("n") > 1)
            .select(F.lit(kind).alias("kind"), "id", "n", "first_other", "last_other")
        )

    return errors("false_merge", "event_id", "event_group_id").unionByName(
        errors("false_split", "event_group_id", "event_id")
    )


def evaluate(
    predictions: DataFrame,
    labels: DataFrame,
    matches: DataFrame,
    by: list[str] | None = None,
    min_positive: int = fv.MIN_POSITIVE_EVENTS,
    order: str = "row_no",
) -> DataFrame:
    """One row of measures per cohort and split (``by``); cohorts are never pooled.

    Ratios with a zero denominator are null.
    """
    by = by or []
    gold = labels.groupBy(*by, "event_group_id").agg(
        F.min_by("decision", order).alias("decision"),
        F.bool_or(F.col("must_not_miss") == "yes").alias("must_not_miss"),
    )
    kept = gold.select("event_group_id", "decision", "must_not_miss")
    p = predictions.select(*by, "event_id", "recommendation").join(
        matches.select("event_id", "event_group_id").join(kept, "event_group_id"), "event_id", "left"
    )
    selected = F.coalesce(F.col("recommendation").isin(fv.SELECTED_RECOMMENDATIONS), F.lit(False))
    review = F.coalesce(F.col("recommendation") == "review_required", F.lit(False))
    correct = selected & F.coalesce(F.col("decision") == "publish", F.lit(False))
    surfaced = (selected | review) & F.coalesce(F.col("must_not_miss"), F.lit(False))
    pred = p.groupBy(*by).agg(
        F.count("*").alias("predicted_events"),
        F.count_if(selected).alias("selected_cards"),
        F.count_if(correct).alias("correct_selections"),
        F.count_if(review).alias("abstained"),
        F.count_if(surfaced).alias("must_not_miss_surfaced"),
    )
    truth = gold.groupBy(*by).agg(
        F.count("*").alias("gold_events"),
        F.count_if(F.col("decision") == "publish").alias("publish_worthy"),
        F.count_if(F.col("must_not_miss")).alias("must_not_miss_events"),
    )
    joined = truth.join(pred, by, "full") if by else truth.join(F.broadcast(pred), F.lit(True), "full")  # one row each
    joined = joined.fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return joined.select(
        *by,
        "gold_events",
        "publish_worthy",
        "predicted_events",
        "selected_cards",
        "correct_selections",
        (F.col("selected_cards") - F.col("correct_selections")).alias("false_positives"),
        F.col("correct_selections").alias("recalled_events"),
        "must_not_miss_events",
        "must_not_miss_surfaced",
        ratio("correct_selections", "selected_cards").alias("selection_precision"),
        ratio("correct_selections", "publish_worthy").alias("important_event_recall"),
        ratio("abstained", "predicted_events").alias("review_required_rate"),
        (F.col("publish_worthy") >= min_positive).alias("evaluable"),
    )


def missed_critical(predictions: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """Must-not-miss gold events that no selected or review-required prediction is matched to."""
    must = labels.filter(F.col("must_not_miss") == "yes").select("event_group_id").distinct()
    shown = predictions.filter(
        F.col("recommendation").isin([*fv.SELECTED_RECOMMENDATIONS, "review_required"])
    ).select("event_id")
    found = matches.join(shown, "event_id", "left_semi").select("event_group_id")
    return must.join(found, "event_group_id", "left_anti")


def sufficiency(articles: DataFrame, labels: DataFrame, by: list[str] | None = None, minimum: int = fv.MIN_POSITIVE_EVENTS) -> DataFrame:
    """Distinct gold events of a partition; publish-worthy when any member says publish."""
    by = by or []
    rows = labels.join(articles.select("article_id", *by).distinct(), "article_id")
    events = rows.groupBy(*by, "event_group_id").agg(F.bool_or(F.col("decision") == "publish").alias("good"))
    return (
        events.groupBy(*by)
        .agg(
            F.count("*").alias("distinct_events"),
            F.count_if("good").alias("publish_worthy_events"),
            F.count_if(~F.col("good")).alias("non_publish_worthy_events"),
        )
        .withColumn("sufficient", F.col("publish_worthy_events") >= minimum)
    )

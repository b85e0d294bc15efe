"""Articles to scored, ranked decisions and a daily edition, then measured against labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import baseline, clusters, matching, scoring, validators
from newsloom.session import cut


def run(
    articles: DataFrame,
    evidence: DataFrame,
    sectors: dict[str, Iterable[str]],
    run_id: str,
    entities: DataFrame | list[dict] | None = None,
    history: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """proposals, members, decisions (ranked, with ``slot``) of one partition; labels are never read."""
    leaks = validators.leaking_fields(articles.schema)
    if leaks:
        raise ValueError(f"evaluator-only fields reached a run: {leaks}")
    proposals = cut(baseline.propose(articles, sectors, entities), "proposals")
    profile = cut(clusters.link_profile(proposals, evidence), "profile")
    members = cut(clusters.cluster_members(profile), "members")
    grouped = cut(clusters.clusters(profile, members), "clusters")
    decisions = clusters.build_decisions(proposals, members, grouped, run_id)
    checked = validators.surface_invalid(validators.validate_decisions(decisions))
    ranked = scoring.rank_decisions(checked, history=history)
    return {
        "proposals": proposals,
        "members": clusters.cluster_articles(members, grouped).withColumnRenamed("cluster_id", "event_id"),
        "decisions": scoring.select_edition(ranked, []),
    }


def measure(result: dict[str, DataFrame], labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Measures of a finished run against gold labels, one row per cohort."""
    matches = matching.match_events(result["members"], labels)
    return matching.evaluate(result["decisions"], labels, matches, by)


def run_counts(result: dict[str, DataFrame]) -> DataFrame:
    """Decisions per recommendation and slot; articles in equal articles with an outcome."""
    return result["decisions"].groupBy("recommendation", "slot").agg(
        F.count("*").alias("events"), F.sum("size").alias("articles")
    )

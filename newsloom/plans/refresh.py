"""One scheduled refresh and the event projection behind the published pages, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import entries, events
from newsloom.operators.events import Overlay
from newsloom.operators.rules import RuleSet
from newsloom.operators.validators import validate_cards


def candidates(parsed: DataFrame, rules: RuleSet, cards: DataFrame, rejected: DataFrame, now: Column) -> DataFrame:
    """Parsed entries of all feeds to the new, rule-matched candidates (:func:`entries.primary_first` orders them).

    ``cards`` are the published ones, ``rejected`` (entry_id, day) the ids turned down recently.
    """
    fresh = entries.fresh_entries(parsed, now)
    known = cards.select(F.col("id").alias("entry_id")).unionByName(
        entries.remembered_rejections(rejected, now).select("entry_id")
    )
    picked = entries.select_candidates(fresh, rules, entries.known_versions(cards), known, registrant_tags="feed_tags")
    return picked.filter("keep")


def publishable(cards: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(valid cards, rejected cards with their errors)."""
    checked = validate_cards(cards, rules.gps, rules.sectors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def project_events(
    cards: DataFrame,
    as_of: Column,
    overlay: Overlay | None = None,
    previous: DataFrame | None = None,
    backfill: DataFrame | None = None,
    repairs: list[dict] | None = None,
) -> dict[str, DataFrame]:
    """events, days, members and (when reviewed) scope tables of one archive."""
    placed = events.place_cards(cards, overlay, previous, backfill, repairs)
    rows = events.events(placed, as_of)
    members = events.event_members(placed)
    out = {
        "events": events.rank_events(rows),
        "days": events.rank_event_days(events.event_days(placed), rows),
        "members": members,
    }
    if overlay and overlay.relevance is not None:
        out["scope"] = events.relevance_scope(members, overlay.relevance)
    return out

"""What a reader sees: day view, all-days view, filters, sort orders, and the fit of the event index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import bilingual


def visible(events: DataFrame) -> DataFrame:
    """Events that a review has not excluded."""
    return events.filter(~F.coalesce(F.col("reviewed_relevance") == "exclude", F.lit(False)))


def tag_filter(entries: DataFrame, gp: str | None = None, sector: str | None = None) -> DataFrame:
    out = entries
    if gp:
        out = out.filter(F.array_contains("gps", gp))
    if sector:
        out = out.filter(F.array_contains("sectors", sector))
    return out


def sort_entries(entries: DataFrame, by: str = "priority") -> DataFrame:
    """Priority rank first (unranked last) then newest; or newest only.  ``ord`` keeps ties stable."""
    newest = [F.col("time").desc_nulls_last(), F.col("ord").asc()]
    return entries.orderBy(*([] if by == "newest" else [F.col("rank").asc_nulls_last()]), *newest)


def index_errors(events: DataFrame, members: DataFrame, day_members: DataFrame) -> DataFrame:
    """Structural faults of an event index: (fault, id).

    Memberships must be disjoint, representatives members, day views inside their events.
    """
    double = (
        members.groupBy("card_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.lit("card in two events").alias("fault"), F.col("card_id").alias("id"))
    )
    keys = members.select("event_id", "card_id")
    rep = events.select("event_id", F.col("representative_card_id").alias("card_id")).join(keys, ["event_id", "card_id"], "left_anti")
    stray = day_members.select("event_id", "card_id").join(keys, ["event_id", "card_id"], "left_anti")
    return double.unionByName(rep.select(F.lit("representative outside event").alias("fault"), F.col("event_id").alias("id"))).unionByName(
        stray.select(F.lit("day member outside event").alias("fault"), F.col("card_id").alias("id"))
    )


def fitting_days(cards: DataFrame, day_members: DataFrame) -> DataFrame:
    """date, fits: the index fits a day when its mapped cards and the index's view agree exactly.

    ``cards``: id, date.  ``day_members``: event_id, card_id, date.  Unmapped cards do not break the fit.
    """
    mapped = cards.select(F.col("id").alias("card_id"), "date").join(
        day_members.select("card_id").distinct(), "card_id", "left_semi"
    )
    both = mapped.withColumn("_c", F.lit(1)).join(
        day_members.select("card_id", "date", "event_id"), ["card_id", "date"], "full"
    )
    # A view with no present card at all belongs to a day or event that is not loaded.
    present = both.filter(F.col("_c").isNotNull() & F.col("event_id").isNotNull()).select("event_id", "date").distinct()
    missing = (
        both.filter(F.col("_c").isNull()).join(present, ["event_id", "date"], "left_semi").select("date")
    )
    misplaced = both.filter(F.col("event_id").isNull()).select("date")
    bad = missing.unionByName(misplaced).distinct().withColumn("_bad", F.lit(True))
    return cards.select("date").distinct().join(bad, "date", "left").select("date", F.col("_bad").isNull().alias("fits"))


def _entry_columns() -> list[str]:
    return ["date", "entry_id", "representative_card_id", "articles", "gps", "sectors", "rank", "time", "grouped"]


def singletons(cards: DataFrame) -> DataFrame:
    """A card without an event is its own entry."""
    return cards.select(
        "date",
        F.col("id").alias("entry_id"),
        F.col("id").alias("representative_card_id"),
        F.lit(1).cast("long").alias("articles"),
        "gps",
        "sectors",
        F.lit(None).cast("long").alias("rank"),
        "time",
        F.lit(False).alias("grouped"),
    )


def day_view(cards: DataFrame, events: DataFrame, days: DataFrame, day_members: DataFrame) -> DataFrame:
    """One entry per event and day, singletons for unmapped cards, raw cards on days the index misfits.

    ``cards``: id, date, gps, sectors, time.  ``events``: event_id, reviewed_relevance.  ``days``:
    event_id, date, representative_card_id, display_gps, display_sectors, priority_rank.
    """
    fit = fitting_days(cards, day_members)
    c = cards.join(fit, "date")
    mapped = c.filter("fits").join(
        day_members.select(F.col("card_id").alias("id"), "date", "event_id"), ["id", "date"], "left"
    )
    alone = singletons(mapped.filter(F.col("event_id").isNull())).unionByName(singletons(c.filter(~F.col("fits"))))
    sizes = mapped.filter(F.col("event_id").isNotNull()).groupBy("event_id", "date").agg(F.count("*").alias("articles"))
    shown = visible(events).select("event_id")
    grouped = (
        sizes.join(shown, "event_id", "left_semi")
        .join(days, ["event_id", "date"])
        .join(cards.select(F.col("id").alias("representative_card_id"), "time"), "representative_card_id")
        .select(
            "date",
            F.col("event_id").alias("entry_id"),
            "representative_card_id",
            "articles",
            F.col("display_gps").alias("gps"),
            F.col("display_sectors").alias("sectors"),
            F.col("priority_rank").cast("long").alias("rank"),
            "time",
            F.lit(True).alias("grouped"),
        )
    )
    return grouped.select(*_entry_columns()).unionByName(alone.select(*_entry_columns()))


def all_view(cards: DataFrame, events: DataFrame, members: DataFrame) -> DataFrame:
    """One entry per visible event over every loaded day, singletons for unmapped cards."""
    present = members.select("event_id", F.col("card_id").alias("id")).join(cards.select("id"), "id")
    sizes = present.groupBy("event_id").agg(F.count("*").alias("articles"), F.min("id").alias("_any"))
    grouped = visible(events).join(sizes, "event_id").select(
        F.lit(None).cast("date").alias("date"),
        F.col("event_id").alias("entry_id"),
        "representative_card_id",
        "articles",
        F.col("display_gps").alias("gps"),
        F.col("display_sectors").alias("sectors"),
        F.col("priority_rank").cast("long").alias("rank"),
        F.col("material_t").alias("time"),
        F.lit(True).alias("grouped"),
    )
    alone = singletons(cards.join(present.select("id"), "id", "left_anti")).withColumn("date", F.lit(None).cast("date"))
    return grouped.select(*_entry_columns()).unionByName(alone.select(*_entry_columns()))


def date_event_counts(view: DataFrame) -> DataFrame:
    """Entries and articles a reader can open per day."""
    return view.groupBy("date").agg(F.count("*").alias("entries"), F.sum("articles").alias("articles"))


def day_index(cards: DataFrame) -> DataFrame:
    """Days with their number of cards, newest first when written."""
    return cards.groupBy("date").agg(F.count("*").alias("cards"))


def tag_labels(entries: DataFrame, labels: DataFrame, key: str, tags: str, lang: str) -> DataFrame:
    """(key, tag, label): tags resolved through the small label dimension (tag, en, zh)."""
    text = bilingual(F.struct("en", "zh"), lang)
    return (
        entries.select(key, F.explode(tags).alias("tag"))
        .join(labels, "tag", "left")
        .select(key, "tag", F.when(text != "", text).otherwise(F.col("tag")).alias("label"))
    )

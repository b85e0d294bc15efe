"""From parsed feed entries to new candidates: freshness, duplicates, versions, order, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import ids, text, times
from newsloom.operators.rules import RuleSet, apply_origin, rule_match
from newsloom.operators.skew import first_by, rank_all


def fresh_entries(entries: DataFrame, now: Column, lookback_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """Drop late and future entries, and filings whose form the feed does not follow."""
    kept = entries.filter(times.fresh(F.col("published"), now, lookback_days))
    if {"form", "forms"} <= set(entries.columns):
        kept = kept.filter(F.col("forms").isNull() | F.expr("array_contains(forms, form)"))
    return kept


def prefer_real_urls(entries: DataFrame) -> DataFrame:
    """An aggregator entry loses to the same headline found with its publisher's own URL."""
    keyed = entries.withColumn("_key", text.title_key(F.col("title")))
    real = keyed.filter(F.col("discovery") == "gdelt").select("_key").distinct()
    opaque = F.coalesce(F.col("feed").startswith("google_news"), F.lit(False))
    # Only aggregator rows take part in the anti join; everything else passes untouched.
    passed = keyed.filter(~opaque)
    checked = keyed.filter(opaque).join(real, "_key", "left_anti")
    return passed.unionByName(checked).drop("_key")


def with_version(entries: DataFrame) -> DataFrame:
    """entry_id and fingerprint of the feed's own title and text."""
    feed_text = F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title"))
    return entries.withColumn("entry_id", ids.card_id(F.col("url"))).withColumn(
        "fingerprint", ids.source_fingerprint(F.col("title"), feed_text)
    )


def distinct_versions(entries: DataFrame, order: list[Column], payload: list[str] | None = None) -> DataFrame:
    """One entry per (entry_id, fingerprint): the first by ``order``.  Partial aggregation, no window."""
    cols = payload or [c for c in entries.columns if c not in ("entry_id", "fingerprint")]
    return first_by(entries, ["entry_id", "fingerprint"], order, cols)


def new_only(entries: DataFrame, known: DataFrame, key: str = "entry_id") -> DataFrame:
    """Entries whose id is not known yet."""
    return entries.join(known.select(key).distinct(), key, "left_anti")


def known_versions(cards: DataFrame) -> DataFrame:
    """Stored versions per source URL: fingerprint, card id and the instant used to order them."""
    observed = F.coalesce("observed_at", "published_at", F.col("date").cast("string"))
    return cards.filter(F.col("source_fingerprint").isNotNull() & (F.col("source_fingerprint") != "")).select(
        ids.card_id(F.col("source.url")).alias("entry_id"),
        F.col("source_fingerprint").alias("fingerprint"),
        F.col("id").alias("card_id"),
        observed.alias("observed"),
    )


def revisions(entries: DataFrame, versions: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """Unseen versions only; a new text under a stored URL carries ``revision_of`` = its latest card.

    An id that is known but has no stored version cannot be compared and is skipped.
    """
    unseen = entries.join(versions.select("entry_id", "fingerprint").distinct(), ["entry_id", "fingerprint"], "left_anti")
    latest = versions.groupBy("entry_id").agg(F.max_by("card_id", F.struct("observed", "card_id")).alias("revision_of"))
    joined = unseen.join(latest, "entry_id", "left")
    if known_ids is None:
        return joined
    marked = joined.join(known_ids.select("entry_id", F.lit(True).alias("_known")).distinct(), "entry_id", "left")
    return marked.filter(F.col("revision_of").isNotNull() | F.col("_known").isNull()).drop("_known")


def select_candidates(
    entries: DataFrame, rules: RuleSet, versions: DataFrame, known_ids: DataFrame, registrant_tags: str | None = None
) -> DataFrame:
    """Aggregator preference, version dedupe, revisions and the keyword rule; rejected rows keep keep=false."""
    staged = with_version(prefer_real_urls(entries))
    unique = distinct_versions(staged, [-times.micros("published"), F.col("url"), F.col("feed")])
    fresh = revisions(unique, versions, known_ids)
    tagged = rule_match(fresh.withColumn("_text", F.concat_ws(" ", "title", "description")), rules, "_text").drop("_text")
    return apply_origin(tagged, tags=registrant_tags)


def primary_first(candidates: DataFrame) -> DataFrame:
    """All candidates with their ``place``: primary records first, then newest; a run with an item cap takes the first places."""
    primary = F.coalesce(F.col("origin").isin(fv.PRIMARY_ORIGINS), F.lit(False))
    return rank_all(candidates, [primary.desc(), F.col("published").desc(), F.col("url").asc()], rank_col="place")


def to_item(candidates: DataFrame) -> DataFrame:
    """Candidate to the item a brief is written from."""
    hit = F.coalesce(ids.host_in(F.col("url"), F.col("domains")), F.lit(False))
    return candidates.select(
        "*",
        times.hkt_date(F.col("published")).alias("date"),
        times.iso_utc(F.col("published")).alias("published_at"),
        F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")).alias("text"),
        F.when(F.col("origin").isNotNull(), F.col("origin").isin(fv.PRIMARY_ORIGINS) & hit).alias("verified_primary_source"),
        F.when(
            F.col("origin") == "issuer_filing",
            F.format_string("Primary source: SEC %s filed by %s.", F.col("form"), F.col("publisher")),
        ).alias("context"),
    )


def merge_evidence(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Swap the feed line for a retrieved excerpt only when the excerpt is longer.

    ``pages``: url, status, level, excerpt, retrieved_at, sha256, source_published_at, final_url.
    """
    got = pages.select(F.col("url"), F.struct(*[c for c in pages.columns if c != "url"]).alias("_page"))
    joined = items.join(got, "url", "left").withColumn("feed_text", F.col("text"))
    longer = (F.col("_page.level") == "excerpt") & (
        F.length(F.coalesce("_page.excerpt", F.lit(""))) > F.length("feed_text")
    )
    use = F.coalesce(longer, F.lit(False))
    level = F.when(use, "excerpt").otherwise("headline_only")
    return joined.withColumns(
        {
            "text": F.when(use, F.col("_page.excerpt")).otherwise(F.col("feed_text")),
            "evidence_level": level,
            "source_published_at": F.col("_page.source_published_at"),
            "evidence": provenance(F.col("_page"), level),
        }
    ).drop("_page")


def provenance(page: Column, level: Column) -> Column:
    """The part of a retrieval record that may be published: no publisher text."""
    return F.struct(
        F.coalesce(page["status"], F.lit("skipped_cap")).alias("status"),
        level.alias("level"),
        page["retrieved_at"].alias("retrieved_at"),
        page["sha256"].alias("sha256"),
        page["source_published_at"].alias("source_published_at"),
        page["final_url"].alias("final_url"),
    )


def stale_modified(items: DataFrame, now: Column, lookback_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """Releases whose page was only edited: dated by a modification time, created before the window."""
    created = F.left("source_published_at", F.lit(10))
    cutoff = F.date_sub(F.to_date(now), lookback_days).cast("string")
    edited = (F.col("published_basis") == "sitemap_lastmod") & F.col("source_published_at").isNotNull()
    stale = F.coalesce(edited & (created < cutoff), F.lit(False))
    redated = F.coalesce(edited & (created >= cutoff), F.lit(False))
    return items.withColumns(
        {
            "stale": stale,
            "published_at": F.when(redated, created).otherwise(F.col("published_at")),
            "date": F.when(redated, F.try_to_timestamp(created).cast("date")).otherwise(F.col("date")),
            "published_basis": F.when(redated, F.lit("page_created_date")).otherwise(F.col("published_basis")),
        }
    )


def rejected_cutoff(now: Column, days: int = fv.REJECTED_MEMORY_DAYS) -> Column:
    return F.date_sub(F.to_date(now), days)


def remembered_rejections(rejected: DataFrame, now: Column) -> DataFrame:
    """Rejected ids still inside the memory window, compared by day (the cutoff day still counts)."""
    return rejected.filter(F.col("day") >= rejected_cutoff(now))


def feed_stats(attempts: DataFrame, parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """Per feed: attempt outcome, fetched and fresh counts."""
    fetched = parsed.groupBy("feed").agg(F.count("*").alias("fetched"))
    fresh = kept.groupBy("feed").agg(F.count("*").alias("fresh"))
    return (
        attempts.groupBy("feed")
        .agg(F.max_by("outcome", "attempted_at").alias("outcome"))
        .join(fetched, "feed", "left")
        .join(fresh, "feed", "left")
        .fillna(0, ["fetched", "fresh"])
    )


def retained(cards: DataFrame, today: Column, window_days: int = fv.RETENTION_DAYS) -> DataFrame:
    """Days inside the rolling window; an older day is dropped and an older insert refused."""
    return cards.filter(F.col("date") >= F.date_sub(today, window_days))


def make_cards(items: DataFrame, repairs: list[dict] | None = None, review_status: str = "unreviewed", origin: str = "auto_fetch", observed_at: Column | None = None) -> DataFrame:
    """Items joined with their parsed brief to cards in the published shape.

    ``items`` carries the item columns of :func:`to_item` plus the brief: headline, summary, gps, sectors,
    region, relevance_reason, assessment_raw (JSON) and event_identity_raw (struct).  A revision gets its
    own id and belongs to the day it was observed.
    """
    from newsloom.functions.identity import display_tags, validate_identity
    from newsloom.functions.priority import validate_assessment

    have = set(items.columns)
    opt = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    title, body = text.clean_text(F.col("title")), text.clean_text(F.col("text"))
    feed_text = F.coalesce(opt("feed_text"), F.col("text"))
    own_id = ids.card_id(F.col("url"))
    print_ = ids.source_fingerprint(F.col("title"), feed_text)
    verified = F.coalesce(opt("verified_primary_source", "boolean"), F.lit(False))
    staged = items.withColumns(
        {
            "_fp": print_,
            "_own": own_id,
            "_assess": validate_assessment(opt("assessment_raw"), title, body, verified),
            "_title": title,
            "_rev": opt("revision_of"),
        }
    )
    seen = observed_at if observed_at is not None else F.lit(None).cast("string")
    revised = F.col("_rev").isNotNull()
    return staged.select(
        F.when(revised, ids.revision_id(F.col("_own"), F.col("_fp"))).otherwise(F.col("_own")).alias("id"),
        F.when(revised & seen.isNotNull(), times.hkt_date(times.instant(seen))).otherwise(F.col("date")).alias("date"),
        "published_at",
        "headline",
        F.struct(
            text.strip_absence(F.col("summary.en"), "en").alias("en"), text.strip_absence(F.col("summary.zh"), "zh").alias("zh")
        ).alias("summary"),
        display_tags(F.col("gps"), F.col("_title"), repairs or []).alias("gps"),
        "sectors",
        "region",
        F.struct(F.col("publisher"), F.col("url")).alias("source"),
        F.lit(review_status).alias("review_status"),
        F.lit(origin).alias("origin"),
        F.col("_title").alias("source_headline"),
        F.col("_fp").alias("source_fingerprint"),
        F.col("_assess").alias("assessment"),
        "relevance_reason",
        (validate_identity(F.col("event_identity_raw"), F.col("title"), F.col("text")) if "event_identity_raw" in have
         else F.lit(None)).alias("event_identity"),
        opt("origin").alias("source_origin"),
        opt("published_basis").alias("published_basis"),
        opt("source_published_at").alias("source_published_at"),
        seen.alias("observed_at"),
        F.col("_rev").alias("supersedes_card_id"),
    )

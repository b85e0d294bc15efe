"""Cards to events: overlay approvals, buckets, revisions, stable ids, representatives, day views, ranks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import ids, times
from newsloom.functions.identity import display_tags, headline_key
from newsloom.functions.priority import classify, rank_columns, validate_assessment
from newsloom.functions.text import normalize_title, strip_absence
from newsloom.operators.components import connected_components
from newsloom.operators.matching import greedy_pairs
from newsloom.operators.skew import attach_per_key, rank_all
from newsloom.operators.stories import headline_stories
from newsloom.session import cut, cut_with, release


@dataclass
class Overlay:
    """Human decisions, all bound to exact card hashes.

    members: event_id, id, headline, card_sha256, role.  groups: event_id, representative_card_id,
    aliases.  corrections: card_id, field, original, corrected, card_sha256.  relations: relation_id,
    event_ids.  relevance: event_id, scope, card_id, card_sha256 (one row per frozen member).
    """

    members: DataFrame | None = None
    groups: DataFrame | None = None
    corrections: DataFrame | None = None
    relations: DataFrame | None = None
    relevance: DataFrame | None = None


# --- overlay ---------------------------------------------------------------------------------
def approved_members(cards: DataFrame, members: DataFrame) -> DataFrame:
    """id, event_id, role of reviewed groups whose every present member still matches.

    ``cards``: id, headline_en, card_sha256.  One changed member voids the whole group; a card in two
    groups is an error.
    """
    once = members.groupBy("id").agg(F.count("*").alias("_groups"))
    guarded = members.join(once, "id").withColumn(
        "id",
        F.when(F.col("_groups") > 1, F.raise_error(F.concat(F.lit("card in two reviewed groups: "), "id"))).otherwise(
            F.col("id")
        ),
    )
    present = guarded.join(
        cards.select("id", F.col("headline_en").alias("_head"), F.col("card_sha256").alias("_sha")), "id"
    ).withColumn(
        "_ok",
        (F.col("_head") == F.col("headline"))
        & (F.col("card_sha256").isNull() | (F.col("card_sha256") == "") | (F.col("card_sha256") == F.col("_sha"))),
    )
    good = present.groupBy("event_id").agg(F.bool_and("_ok").alias("_all")).filter("_all").select("event_id")
    return present.join(good, "event_id", "left_semi").select("id", "event_id", F.coalesce("role", F.lit("coverage")).alias("role"))


def valid_corrections(cards: DataFrame, corrections: DataFrame) -> DataFrame:
    """Publication-date corrections whose card, original value and hash all still agree."""
    return (
        corrections.filter(F.col("field") == "published_at")
        .join(cards.select(F.col("id").alias("card_id"), "published_at", F.col("card_sha256").alias("_sha")), "card_id")
        .filter(F.col("published_at").eqNullSafe(F.col("original")) & (F.col("_sha") == F.col("card_sha256")))
        .select(F.col("card_id").alias("id"), "corrected")
    )


def apply_backfill(cards: DataFrame, side: DataFrame) -> DataFrame:
    """Replace assessment and summary while the card still equals the hash it was re-briefed from."""
    found = side.filter(F.col("assessment").isNotNull()).select(
        F.col("card_id").alias("id"),
        F.col("card_sha256").alias("_sha"),
        F.col("assessment").alias("_assessment"),
        F.col("summary").alias("_summary"),
        (F.col("resolved_url") if "resolved_url" in side.columns else F.lit(None).cast("string")).alias("_url"),
    )
    joined = cards.join(found, "id", "left")
    fits = F.coalesce(F.col("_sha") == F.col("card_sha256"), F.lit(False))
    return joined.withColumns(
        {
            "assessment": F.when(fits, F.col("_assessment")).otherwise(F.col("assessment")),
            "summary": F.when(fits, F.col("_summary")).otherwise(F.col("summary")),
            "evidence_url": F.when(fits, F.col("_url")),
            "updated": fits,
        }
    ).drop("_sha", "_assessment", "_summary", "_url")


def relevance_scope(members: DataFrame, reviews: DataFrame) -> DataFrame:
    """event_id, scope where the reviewed hashes are exactly the event's current membership.

    ``members``: event_id, card_id, card_sha256.  ``reviews``: event_id, scope, card_id, card_sha256.
    """
    r = reviews.filter(F.col("scope").isin("include", "exclude"))
    wanted = r.select("event_id", "scope", "card_id", F.col("card_sha256").alias("_want"))
    named = r.select("event_id").distinct()
    have = members.join(named, "event_id", "left_semi")
    both = have.select("event_id", "card_id", "card_sha256").join(wanted, ["event_id", "card_id"], "full")
    agree = F.coalesce(F.col("card_sha256") == F.col("_want"), F.lit(False))
    return (
        both.groupBy("event_id").agg(F.bool_and(agree).alias("ok"), F.max("scope").alias("scope")).filter("ok").select("event_id", "scope")
    )


def related_events(names: DataFrame, relations: DataFrame) -> DataFrame:
    """(event_id, related_event_id), symmetric, without self.

    ``names``: name, event_id (ids and aliases).  ``relations``: relation_id, event_ids.
    """
    linked = (
        relations.select("relation_id", F.explode("event_ids").alias("name"))
        .join(names, "name")
        .select("relation_id", "event_id")
        .distinct()
    )
    other = linked.select("relation_id", F.col("event_id").alias("related_event_id"))
    return (
        linked.join(other, "relation_id").filter(F.col("event_id") != F.col("related_event_id")).select(
            "event_id", "related_event_id"
        ).distinct()
    )


# --- buckets ---------------------------------------------------------------------------------
def auto_key(card_id: Column, identity: Column, url: Column, fingerprint: Column) -> Column:
    """Bucket key without a headline: validated identity, else exact source version, else the card."""
    fields = [identity[f] for f in ("subject", "action", "object", "period")]
    full = identity["version"] == fv.IDENTITY_VERSION
    for f in fields:
        full = full & f.isNotNull() & (f != "")
    numbers = F.coalesce(identity["numbers"], F.array().cast("array<string>"))
    packed = F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)], numbers.alias("n")))
    return (
        F.when(F.coalesce(full, F.lit(False)), F.concat(F.lit("identity|"), packed))
        .when(F.coalesce(fingerprint != "", F.lit(False)), F.concat(F.lit("source|"), url, F.lit("|"), fingerprint))
        .otherwise(F.concat(F.lit("single|"), card_id))
    )


def same_revision(card: str, parent: str) -> Column:
    """Child and parent share the canonical URL, and their identities agree or headlines are equal."""
    c, p = (lambda n: F.col(f"{card}.{n}")), (lambda n: F.col(f"{parent}.{n}"))
    agree = F.lit(True)
    for f in ("subject", "action", "object", "period"):
        agree = agree & c("event_identity")[f].eqNullSafe(p("event_identity")[f])
    both = c("event_identity").isNotNull() & p("event_identity").isNotNull()
    titles = F.coalesce(
        (c("source_headline") != "")
        & (normalize_title(c("source_headline")) == normalize_title(F.coalesce(p("source_headline"), F.lit("")))),
        F.lit(False),
    )
    return (c("url_key") == p("url_key")) & F.when(both, agree).otherwise(titles)


def merge_revisions(keyed: DataFrame) -> DataFrame:
    """id, bucket after linked revisions joined their parent's bucket.

    ``keyed``: id, bucket, supersedes_card_id, observed_at, url_key, event_identity, source_headline.  Links act in time
    order: each moves everything gathered under the child's bucket to the key its parent's bucket has by then; a link
    inside one key does nothing.
    """
    child = keyed.filter(F.col("supersedes_card_id").isNotNull() & (F.col("supersedes_card_id") != F.col("id")))
    links = (
        child.alias("c")
        .join(keyed.alias("p"), F.col("c.supersedes_card_id") == F.col("p.id"))
        .filter(same_revision("c", "p") & (F.col("c.bucket") != F.col("p.bucket")))
        .select(
            F.col("c.bucket").alias("a"),
            F.col("p.bucket").alias("b"),
            F.coalesce("c.observed_at", F.lit("")).alias("at"),
            F.col("c.id").alias("cid"),
        )
    )
    links = cut(links, "revisions")
    if links.isEmpty():
        return keyed.select("id", "bucket")
    renamed = _follow_links(links)
    return attach_per_key(keyed.select("id", "bucket"), renamed, ["bucket"]).select("id", F.coalesce("final", "bucket").alias("bucket"))


def _earliest(links: DataFrame) -> DataFrame:
    """One link per pair of keys: once a link has acted, its keys share a name, so a later one between them does nothing."""
    when = F.min(F.struct("at", "cid", "a", "b"))
    pairs = links.filter("a <> b").groupBy("group", F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).agg(when.alias("w"))
    return pairs.select("group", "w.*")


def _pointed(pointers: DataFrame) -> DataFrame:
    """(key, to) without cycles to (key, root), by doubling: O(log n) written rounds for chains of n."""
    current, seen = cut_with(pointers, "pointers", n=F.count(F.lit(1)))
    while seen["n"]:
        onward = current.select(F.col("key").alias("_k"), F.col("to").alias("_to"))
        following, moved = cut_with(current.join(onward, F.col("to") == F.col("_k"), "left").select("key", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "pointers", n=F.count_if(F.col("moved")))
        release(current)
        current, seen = following, moved
    return current.select("key", "to")


def _follow_links(links: DataFrame) -> DataFrame:
    """bucket, final: the key each linked bucket ends under when links (a -> b at time ``at``, ``cid``) act in order.

    Keys that are linked in any way end under one key, the one that never gave way.  It is found per group of linked keys:

    * if no key of a group has two ways out and one has none, every other key gives way when its only link acts, so that one stays;
    * in other groups a key whose earliest link leads away has gathered nothing by then and shares its parent's name for ever
      after, so it is replaced by its parent in all later links.  All such keys go at once, chains of them by doubling (their times
      fall along the chain, so there are no cycles).

    Revision chains of any length thus take O(log n) rounds, whether their links act from the old end or the new one.  Only a path
    whose links act towards its head, in a group where some key also has two ways out, takes a round per link.
    """
    groups = cut(connected_components(links.select("a", "b")).select(F.col("node").alias("bucket"), F.col("root").alias("group")), "revision-groups")
    rest = cut(_earliest(links.join(groups, F.col("a") == F.col("bucket")).drop("bucket")), "revisions")
    names = []
    while not rest.isEmpty():
        ends = rest.select("group", F.explode(F.array(F.struct(F.col("a").alias("key"), F.lit(1).alias("out")), F.struct(F.col("b").alias("key"), F.lit(0).alias("out")))).alias("e"), F.struct("at", "cid", "a", "b").alias("w"))
        keys = cut(ends.groupBy("group", "e.key").agg(F.sum("e.out").alias("ways"), F.min("w").alias("first")), "revision-keys")
        shape = keys.groupBy("group").agg(F.max("ways").alias("most"), F.count_if(F.col("ways") == 0).alias("ends"), F.max(F.when(F.col("ways") == 0, F.col("key"))).alias("name"))
        plain = cut(shape.filter("most = 1 AND ends = 1").select("group", "name"), "revision-names")
        names.append(plain)
        open_ = rest.join(plain.select("group"), "group", "left_anti")
        gone = _pointed(keys.join(plain.select("group"), "group", "left_anti").filter(F.col("first.a") == F.col("key")).select("key", F.col("first.b").alias("to")))
        away = lambda c: gone.select(F.col("key").alias(f"_{c}"), F.col("to").alias(f"_{c}to"))
        moved = open_.join(away("a"), F.col("a") == F.col("_a"), "left").join(away("b"), F.col("b") == F.col("_b"), "left")
        following = cut(_earliest(moved.select("group", F.coalesce("_ato", "a").alias("a"), F.coalesce("_bto", "b").alias("b"), "at", "cid")), "revisions")
        # A group without links left has one key left: where its others went.
        ended = open_.select("group", F.col("b").alias("key")).join(following.select("group"), "group", "left_anti").join(gone, "key", "left")
        names.append(cut(ended.groupBy("group").agg(F.min(F.coalesce("to", "key")).alias("name")), "revision-names"))
        release(rest)
        release(keys)
        rest = following
    found = reduce(DataFrame.unionByName, names)
    return groups.join(found, "group").select("bucket", F.col("name").alias("final"))


def carry_event_ids(buckets: DataFrame, members: DataFrame, prior: DataFrame, reserved: DataFrame) -> DataFrame:
    """bucket, event_id: the earliest member's prior event unless an earlier bucket took it.

    ``buckets``: bucket, first_t, first_id.  ``members``: bucket, id, t.  ``prior``: id, event_id.
    ``reserved``: event ids of reviewed groups, taken before anything else.
    """
    wish = (
        members.join(prior.withColumnRenamed("event_id", "prior_id"), "id")
        .join(reserved.select(F.col("event_id").alias("prior_id")), "prior_id", "left_anti")
        .groupBy("bucket", "prior_id")
        .agg(F.min(F.struct("t", "id")).alias("m"))
        .join(buckets, "bucket")
        .select("bucket", "prior_id", "first_t", "first_id", F.col("m.t").alias("t"), F.col("m.id").alias("id"))
    )
    got = greedy_pairs(wish, "bucket", "prior_id", ["first_t", "first_id", "t", "id", "prior_id"])
    own = F.concat(F.lit("evt-"), F.col("first_id"))
    taken = got.select(F.col("prior_id").alias("_taken")).unionByName(reserved.select(F.col("event_id").alias("_taken"))).distinct()
    named = buckets.join(got.select("bucket", "prior_id"), "bucket", "left").join(taken, own == F.col("_taken"), "left")
    # An id of its own that another bucket carries over gets a mark of its bucket, so no two buckets share an id.
    fresh = F.when(F.col("_taken").isNull(), own).otherwise(F.concat(own, F.lit("-"), F.substring(F.sha2("bucket", 256), 1, 6)))
    return named.select("bucket", F.coalesce("prior_id", fresh).alias("event_id"))


# --- representatives -------------------------------------------------------------------------
def representative_order(prefix: str = "") -> Column:
    """Reviewed first, assessable first, longest informative summary, earliest, id — as one struct."""
    c = lambda n: F.col(prefix + n)
    return F.struct(
        (~F.coalesce(c("review_status") == "reviewed", F.lit(False))).alias("a"),
        (~c("assessable")).alias("b"),
        (-c("summary_size")).alias("c"),
        c("t").alias("d"),
        c("id").alias("e"),
    )


def picks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: chosen card, priority source card, first card — one partial aggregation, no window.

    chosen = pinned, else latest revision, else representative; the priority source is the chosen card
    when assessable, else the best assessable member.
    """
    revision = F.col("supersedes_card_id").isNotNull()
    rep = F.col("rep_order")
    card = F.struct("id", "assessable")
    agg = rows.groupBy(*keys).agg(
        F.min_by(card, F.when(F.col("pinned"), rep)).alias("_pinned"),
        F.max_by(card, F.when(revision, F.struct("revision_t", "id"))).alias("_revised"),
        F.min_by(card, rep).alias("_rep"),
        F.min_by("id", F.when(F.col("assessable"), rep)).alias("_supported"),
        F.min_by("id", F.struct("t", "id")).alias("first_id"),
        F.bool_or(revision).alias("updated"),
        F.count("*").alias("members"),
    )
    chosen = F.coalesce("_pinned", "_revised", "_rep")
    return agg.withColumn("_chosen", chosen).select(
        *keys,
        F.col("_chosen.id").alias("representative_card_id"),
        F.when(F.col("_chosen.assessable"), F.col("_chosen.id"))
        .otherwise(F.coalesce("_supported", F.col("_chosen.id")))
        .alias("priority_source_card_id"),
        F.col("_revised.id").alias("latest_revision_id"),
        "first_id",
        "updated",
        "members",
    )


def fallback_assessment(cards: DataFrame) -> DataFrame:
    """Cards without an assessment are judged as headline-only."""
    title = F.coalesce("source_headline", F.col("headline.en"))
    empty = validate_assessment(F.lit(None).cast("string"), title, title, F.lit(False))
    return cards.withColumn("assessment", F.coalesce("assessment", empty))


# --- projection ------------------------------------------------------------------------------
def place_cards(
    cards: DataFrame,
    overlay: Overlay | None = None,
    previous: DataFrame | None = None,
    backfill: DataFrame | None = None,
    repairs: list[dict] | None = None,
) -> DataFrame:
    """Every card with its event_id and merge rule, ready for the event tables.

    ``previous``: id, event_id of the last projection.  Each card is in exactly one event.  The summary stays with the card: only
    its length takes part, as ``summary_size``.
    """
    overlay = overlay or Overlay()
    base = cards
    if "card_sha256" not in base.columns:
        base = base.withColumn("card_sha256", ids.canonical_hash(F.struct(*[F.col(c) for c in cards.columns])))
    for name, kind in (
        ("observed_at", "string"), ("supersedes_card_id", "string"), ("material_update_confirmed", "boolean"),
    ):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    base = base.withColumn("headline_en", F.col("headline.en"))
    if backfill is not None:
        base = apply_backfill(base, backfill)
    else:
        base = base.withColumns({"evidence_url": F.lit(None).cast("string"), "updated": F.lit(False)})
    base = fallback_assessment(base)
    own = times.stamp(F.col("published_at"), F.col("date"))
    if overlay.corrections is not None:
        base = base.join(valid_corrections(base, overlay.corrections), "id", "left")
        stamp = F.when(F.col("corrected").isNotNull(), times.corrected_stamp(F.col("corrected"))).otherwise(own)
    else:
        base = base.withColumn("corrected", F.lit(None).cast("string"))
        stamp = own
    base = base.withColumn("stamp", stamp).withColumn("own_stamp", own)
    base = base.withColumns(
        {
            "t": times.micros(times.instant(F.col("stamp"))),
            "head": headline_key(F.col("source_headline")),
            "url_key": ids.event_url(F.col("source.url")),
            "assessable": F.coalesce(F.col("assessment.assessable"), F.lit(False)),
            "summary_size": F.length(strip_absence(F.col("summary.en"), "en")),
        }
    )
    if overlay.members is not None:
        approved = approved_members(base, overlay.members).withColumnRenamed("event_id", "reviewed_event")
        base = base.join(approved, "id", "left")
    else:
        base = base.withColumns({"reviewed_event": F.lit(None).cast("string"), "role": F.lit(None).cast("string")})
    # Several steps read the prepared cards; the hash, title and URL columns are computed once.  No step reads the text again.
    base = cut(base.drop("summary"), "cards")
    headed = base.filter(F.col("head").isNotNull()).select("id", "head", "t", "reviewed_event")
    anchors = headed.filter(F.col("reviewed_event").isNotNull()).select(
        "id", "head", "t", F.concat(F.lit("reviewed|"), "reviewed_event").alias("story")
    )
    loose = headed.filter(F.col("reviewed_event").isNull()).select("id", "head", "t")
    stories = headline_stories(loose, anchors if overlay.members is not None else None)
    auto = auto_key(F.col("id"), F.col("event_identity"), F.col("url_key"), F.col("source_fingerprint"))
    keyed = base.join(stories, "id", "left").withColumn("auto", auto)
    in_reviewed = F.col("story").startswith("reviewed|")
    bucket = (
        F.when(F.col("reviewed_event").isNotNull(), F.concat(F.lit("reviewed|"), "reviewed_event"))
        .when(in_reviewed, F.col("story"))
        .when(F.col("story").isNotNull(), F.concat(F.lit("headline|"), "story"))
        .otherwise(F.col("auto"))
    )
    keyed = cut(keyed.withColumn("bucket", bucket).drop("story"), "keyed")
    merged = merge_revisions(
        keyed.select("id", "bucket", "supersedes_card_id", "observed_at", "url_key", "event_identity", "source_headline")
    )
    placed = keyed.drop("bucket").join(merged, "id")
    heads = placed.groupBy("bucket").agg(
        F.min(F.struct("t", "id")).alias("f"), F.min_by("auto", F.struct("t", "id")).alias("auto"), F.count("*").alias("_n")
    )
    buckets = heads.select("bucket", F.col("f.t").alias("first_t"), F.col("f.id").alias("first_id"))
    reviewed = F.col("bucket").startswith("reviewed|")
    fixed = buckets.filter(reviewed).select("bucket", F.expr("substring(bucket, 10)").alias("event_id"))
    free = buckets.filter(~reviewed)
    if previous is None:
        named = free.select("bucket", F.concat(F.lit("evt-"), "first_id").alias("event_id"))
    else:
        named = carry_event_ids(
            free, placed.filter(~reviewed).select("bucket", "id", "t"), previous.select("id", "event_id"), fixed.select("event_id")
        )
    kind = F.substring_index("bucket", "|", 1)
    lone = (kind == "headline") & (F.col("_n") == 1)
    rules = heads.select(
        "bucket", F.when(lone, F.substring_index("auto", "|", 1)).otherwise(kind).alias("merge_rule"), "_n"
    )
    per_bucket = fixed.unionByName(named).join(rules, "bucket")
    out = attach_per_key(placed, per_bucket, ["bucket"], "_n").drop("auto", "_n")
    if overlay.groups is not None:
        pins = overlay.groups.select(F.col("event_id").alias("reviewed_event"), F.col("representative_card_id").alias("id"), F.lit(True).alias("pinned"))
        out = out.join(pins, ["reviewed_event", "id"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    else:
        out = out.withColumn("pinned", F.lit(False))
    title = F.coalesce("source_headline", "headline_en")
    out = out.withColumns(
        {
            "display_gps": display_tags(F.col("gps"), title, repairs or []),
            "revision_t": times.micros(times.instant(F.coalesce("observed_at", "stamp"))),
            "role": F.coalesce("role", F.lit("coverage")),
        }
    )
    return cut(out.withColumn("rep_order", representative_order()), "placed")


def _attach_card(frame: DataFrame, placed: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    side = placed.select(F.col("id").alias(key), *[F.col(src).alias(dst) for dst, src in fields.items()])
    return frame.join(side, key, "left")


def event_days(placed: DataFrame) -> DataFrame:
    """One row per (event, day): chosen card, tags, further coverage, day-end priority and day rank."""
    first = placed.groupBy("event_id").agg(F.min_by("date", F.struct("t", "id")).alias("first_day"))
    days = picks(placed, ["event_id", "date"]).join(first, "event_id")
    days = _attach_card(days, placed, "representative_card_id", {"display_gps": "display_gps", "display_sectors": "sectors"})
    days = _attach_card(days, placed, "priority_source_card_id", {"_a": "assessment"})
    day_end = F.to_timestamp(F.concat(F.col("date").cast("string"), F.lit("T23:59:59+08:00")))
    days = days.withColumn("priority", classify(F.col("_a"), day_end)).drop("_a")
    return days.withColumn("further_coverage", F.col("date") != F.col("first_day")).drop("first_day", "latest_revision_id", "updated", "first_id")


def events(placed: DataFrame, as_of: Column) -> DataFrame:
    """One row per event: chosen card, stamps, tags, priority at ``as_of``, merge rule."""
    head = picks(placed, ["event_id"])
    update = F.when(F.col("role") == "update", F.struct("t", "stamp"))
    extra = placed.groupBy("event_id").agg(
        F.first("merge_rule").alias("merge_rule"),
        F.min_by(F.struct("stamp", "t", "corrected", "published_at", "own_stamp"), F.struct("t", "id")).alias("_first"),
        F.max(update).alias("_update"),
    )
    out = head.join(extra, "event_id")
    out = _attach_card(
        out, placed, "latest_revision_id",
        {"_rt": "revision_t", "_robs": "observed_at", "_rstamp": "stamp", "_rok": "material_update_confirmed"},
    )
    out = _attach_card(out, placed, "representative_card_id", {"display_gps": "display_gps", "display_sectors": "sectors"})
    out = _attach_card(out, placed, "priority_source_card_id", {"_a": "assessment"})
    moments = F.array(
        F.struct(F.col("_first.t").alias("t"), F.col("_first.stamp").alias("s")),
        F.struct(F.col("_update.t").alias("t"), F.col("_update.stamp").alias("s")),
        F.when(
            F.col("_rok"), F.struct(F.col("_rt").alias("t"), F.coalesce("_robs", "_rstamp").alias("s"))
        ),
    )
    latest = F.array_max(F.filter(moments, lambda m: m["t"].isNotNull()))
    basis = (
        F.when(F.col("_first.corrected").isNotNull(), "corrected")
        .when(F.col("_first.published_at") == F.col("_first.own_stamp"), "published_at")
        .otherwise("date_only")
    )
    return out.select(
        "event_id",
        "members",
        "representative_card_id",
        "priority_source_card_id",
        F.col("_first.stamp").alias("first_seen_at"),
        latest["s"].alias("last_material_update_at"),
        latest["t"].alias("material_t"),
        basis.alias("timestamp_basis"),
        "updated",
        F.col("_robs").alias("last_source_revision_at"),
        "merge_rule",
        "display_gps",
        "display_sectors",
        classify(F.col("_a"), as_of).alias("priority"),
    )


def rank_events(event_rows: DataFrame) -> DataFrame:
    """Archive-wide priority rank."""
    order = rank_columns(F.col("priority"), F.timestamp_micros("material_t"), F.col("event_id"))
    return rank_all(event_rows, order, [], "priority_rank")


def rank_event_days(days: DataFrame, event_rows: DataFrame) -> DataFrame:
    """Priority rank inside each calendar day, from the day's own priority."""
    joined = days.join(event_rows.select("event_id", "material_t"), "event_id")
    order = rank_columns(F.col("priority"), F.timestamp_micros("material_t"), F.col("event_id"))
    return rank_all(joined, order, ["date"], "priority_rank").drop("material_t")


def event_members(placed: DataFrame) -> DataFrame:
    """Membership as rows; the reader's per-event list is an ordered scan of it."""
    return placed.select(
        "event_id",
        F.col("id").alias("card_id"),
        "date",
        "stamp",
        "t",
        "role",
        "card_sha256",
        F.col("source.publisher").alias("publisher"),
        F.col("source.url").alias("url"),
        "evidence_url",
        "corrected",
    )


def event_aliases(placed: DataFrame, previous: DataFrame, prior_aliases: DataFrame | None, groups: DataFrame | None) -> DataFrame:
    """(event_id, alias): ids absorbed from earlier projections and reviewed aliases, minus ids in use."""
    prior = previous.select("id", F.col("event_id").alias("alias"))
    absorbed = placed.select("id", "event_id").join(prior, "id").select("event_id", "alias").distinct()
    if prior_aliases is not None:
        older = absorbed.join(
            prior_aliases.select(F.col("event_id").alias("alias"), F.col("alias").alias("older")), "alias"
        ).select("event_id", F.col("older").alias("alias"))
        absorbed = absorbed.unionByName(older)
    if groups is not None:
        absorbed = absorbed.unionByName(groups.select("event_id", F.explode("aliases").alias("alias")))
    used = placed.select(F.col("event_id").alias("alias")).distinct()
    return absorbed.distinct().join(used, "alias", "left_anti")


def archive_fingerprint(cards: DataFrame, digest: str = "card_sha256") -> DataFrame:
    """One digest of a whole table, independent of row order, as a plain partial aggregate.

    Each 256-bit row digest is summed in four 64-bit lanes; the lanes and the row count are digested.
    """
    lanes = [
        F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string")
        for i in range(4)
    ]
    rows = F.count(digest)
    return cards.agg(
        rows.alias("rows"),
        F.sha2(F.concat_ws("|", rows.cast("string"), *[F.coalesce(x, F.lit("0")) for x in lanes]), 256).alias("fingerprint"),
    )

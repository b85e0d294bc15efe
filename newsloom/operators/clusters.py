"""Articles to predicted events: linking evidence, components, ambiguity, one decision per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.text import normalize_party
from newsloom.operators.components import connected_components
from newsloom.operators.scoring import evaluate_gates
from newsloom.operators.skew import attach_per_key, first_by


def link_profile(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """The columns linking depends on: URL, digest, superseded id, type, parties, vehicle, period, date."""
    identity = F.col("event_identity")
    named = F.coalesce(identity["parties"], F.array().cast("array<string>"))
    direct = F.coalesce(F.col("direct_entity_ids"), F.array().cast("array<string>"))
    parties = F.array_distinct(
        F.filter(F.transform(F.array_union(direct, named), normalize_party), lambda p: p != "")
    )
    side = evidence.select("article_id", "canonical_url", "evidence_hash", "supersedes_article_id")
    return proposals.select(
        "article_id",
        F.coalesce("primary_event_type", F.lit("")).alias("type"),
        parties.alias("parties"),
        normalize_party(identity["vehicle"]).alias("vehicle"),
        normalize_party(identity["period"]).alias("period"),
        F.coalesce(identity["event_date"], F.lit("")).alias("event_date"),
    ).join(side, "article_id", "left")


def _star(rows: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """Edges from every row of a group to the group's smallest id: n rows give n-1 edges, not n^2."""
    low = rows.groupBy(*keys).agg(
        F.min("article_id").alias("hub"),
        F.count("*").alias("n"),
        F.min(F.when(only, F.col("article_id"))).alias("open_hub") if only is not None else F.lit(None).alias("open_hub"),
    )
    low = low.filter(F.col("n") > 1)
    if only is not None:
        low = low.filter(F.col("open_hub").isNotNull())
    hub = F.col("hub")
    joined = attach_per_key(rows, low, keys, "n", how="inner")
    return joined.filter(F.col("article_id") != hub).select(hub.alias("a"), F.col("article_id").alias("b"))


def link_edges(profile: DataFrame) -> DataFrame:
    """Edges (a, b, kind) whose components are the events; linear in the number of articles.

    Every pair that should merge shares one of: URL, digest, a supersedes link, or (type, party) with
    an equal vehicle, period or date.  Each of these is an equality, so a group is linked as a star:

    * vehicle: all members with one vehicle under one (type, party) merge;
    * period or date: two members merge unless both name a vehicle, so the group is connected exactly
      when at least one member names none, and then all of it is.
    """
    url = _star(profile.filter(F.col("canonical_url") != "").select("article_id", "canonical_url"), ["canonical_url"])
    text = _star(profile.filter(F.col("evidence_hash") != "").select("article_id", "evidence_hash"), ["evidence_hash"])
    known = profile.select(F.col("article_id").alias("supersedes_article_id"))
    sup = (
        profile.filter(F.col("supersedes_article_id").isNotNull())
        .join(known, "supersedes_article_id")
        .select(F.col("supersedes_article_id").alias("a"), F.col("article_id").alias("b"))
    )
    party = profile.select("article_id", "type", "vehicle", "period", "event_date", F.explode("parties").alias("party"))
    no_vehicle = F.col("vehicle") == ""
    by_vehicle = _star(party.filter(~no_vehicle), ["type", "party", "vehicle"])
    by_period = _star(party.filter(F.col("period") != ""), ["type", "party", "period"], no_vehicle)
    by_date = _star(party.filter(F.col("event_date") != ""), ["type", "party", "event_date"], no_vehicle)
    tagged = [(url, "url"), (text, "text"), (sup, "supersedes"), (by_vehicle, "vehicle"), (by_period, "period"), (by_date, "date")]
    out = None
    for frame, kind in tagged:
        frame = frame.select("a", "b", F.lit(kind).alias("kind"))
        out = frame if out is None else out.unionByName(frame)
    return out


def cluster_members(profile: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """article_id, root (smallest article of its cluster)."""
    links = edges if edges is not None else link_edges(profile)
    roots = connected_components(links.select("a", "b"))
    return profile.select("article_id").join(
        roots.select(F.col("node").alias("article_id"), "root"), "article_id", "left"
    ).select("article_id", F.coalesce("root", "article_id").alias("root"))


def cluster_ids(members: DataFrame) -> DataFrame:
    """root, cluster_id, size.  The id is a digest of the set of article ids, as plain sums for a cluster of any size.

    The SHA-256 of every id is summed in four 64-bit lanes; lanes and count are digested.
    """
    digest = F.sha2("article_id", 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    text = F.concat_ws("|", *[c.cast("string") for c in (F.count(F.lit(1)), *lanes)])
    return members.groupBy("root").agg(
        F.concat(F.lit("pe-"), F.substring(F.sha2(text, 256), 1, 12)).alias("cluster_id"), F.count(F.lit(1)).alias("size")
    )


def duplicates(profile: DataFrame, members: DataFrame) -> DataFrame:
    """Articles that repeat another one's URL or text, other than the first article of their cluster."""
    repeated = None
    for key in ("canonical_url", "evidence_hash"):
        counts = profile.filter(F.col(key) != "").groupBy(key).agg(F.count("*").alias("copies"))
        counts = counts.filter(F.col("copies") > 1)
        hit = attach_per_key(profile.select("article_id", key).filter(F.col(key) != ""), counts, [key], "copies", how="inner")
        hit = hit.select("article_id")
        repeated = hit if repeated is None else repeated.unionByName(hit)
    return members.join(repeated.distinct(), "article_id", "left_semi").filter(F.col("article_id") != F.col("root"))


def ambiguity_blocks(profile: DataFrame, members: DataFrame) -> DataFrame:
    """Per (type, party): smallest and largest cluster root, over all members and over those without a vehicle."""
    party = profile.select("article_id", "type", "vehicle", F.explode("parties").alias("party")).join(members, "article_id")
    free = F.when(F.col("vehicle") == "", F.col("root"))
    return party.groupBy("type", "party").agg(
        F.min("root").alias("lo"),
        F.max("root").alias("hi"),
        F.min(free).alias("free_lo"),
        F.max(free).alias("free_hi"),
        F.count("*").alias("n"),
    )


def ambiguous_roots(profile: DataFrame, members: DataFrame) -> DataFrame:
    """Roots of clusters with an unresolved neighbour, decided without forming any pair.

    Two articles of one (type, party) block in different clusters are unresolved exactly when at least
    one names no vehicle: any link would have merged them, and two different vehicles are two deals.
    So a member without a vehicle is unresolved when its block holds any other cluster, and a member
    with one when the block's vehicle-free members belong to another cluster.  Minima and maxima of the
    roots per block decide both.
    """
    blocks = ambiguity_blocks(profile, members)
    party = profile.select("article_id", "type", "vehicle", F.explode("parties").alias("party")).join(members, "article_id")
    seen = attach_per_key(party, blocks, ["type", "party"], "n")
    other = lambda lo, hi: (F.col(lo) != F.col("root")) | (F.col(hi) != F.col("root"))
    unresolved = F.when(F.col("vehicle") == "", other("lo", "hi")).otherwise(other("free_lo", "free_hi"))
    return seen.filter(F.coalesce(unresolved, F.lit(False))).select("root").distinct()


def partner_blocks(profile: DataFrame, members: DataFrame) -> DataFrame:
    """(root, type, party, free, partners): where each cluster has unresolved neighbours, and how many there.

    The partners of a cluster in a block are the block's articles of other clusters; all of them if the cluster has an article
    without vehicle there (``free``), else those without vehicle.  So this table, no longer than the list of articles and
    parties, says who is whose partner for all clusters, and no pair is ever listed.
    """
    party = profile.select("article_id", "type", "vehicle", F.explode(F.array_distinct("parties")).alias("party")).join(members, "article_id")
    own = party.groupBy("root", "type", "party").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vehicle") == "").alias("n_free"))
    whole = own.groupBy("type", "party").agg(F.sum("n").alias("all_n"), F.sum("n_free").alias("all_free"))
    seen = attach_per_key(own, whole, ["type", "party"])
    free = F.col("n_free") > 0
    partners = F.when(free, F.col("all_n") - F.col("n")).otherwise(F.col("all_free") - F.col("n_free"))
    return seen.select("root", "type", "party", free.alias("free"), partners.alias("partners")).filter("partners > 0")


def partner_members(profile: DataFrame, members: DataFrame) -> DataFrame:
    """(root, article_id, type, party, open, free, partners): the blocks of :func:`partner_blocks` with the articles in them.

    An article is a partner of every other cluster of its block that is ``free``, and of the others too if it is ``open`` itself (without
    vehicle).  So every pair of cluster and partner is told, in as many rows as the articles have parties.
    """
    party = profile.select("article_id", "type", (F.col("vehicle") == "").alias("open"), F.explode(F.array_distinct("parties")).alias("party")).join(members.select("article_id", "root"), "article_id")
    told = attach_per_key(party, partner_blocks(profile, members), ["root", "type", "party"], how="inner")
    return told.select("root", "article_id", "type", "party", "open", "free", "partners")


def ambiguous_partners(profile: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, article_id) partners of the given clusters, for review screens.

    The list is as long as the blocks it names, so it is produced for chosen clusters only; the flag in
    :func:`ambiguous_roots` never needs it.
    """
    party = profile.select("article_id", "type", "vehicle", F.explode("parties").alias("party")).join(members, "article_id")
    wanted = (
        party.join(roots.select("root").distinct(), "root", "left_semi")
        .groupBy("root", "type", "party")
        .agg(F.bool_or(F.col("vehicle") == "").alias("free"))
    )
    others = party.select("type", "party", F.col("root").alias("other"), "article_id", "vehicle")
    return (
        wanted.join(others, ["type", "party"])
        .filter((F.col("root") != F.col("other")) & (F.col("free") | (F.col("vehicle") == "")))
        .select("root", "article_id")
        .distinct()
    )


def clusters(profile: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per cluster: cluster_id, root, size, duplicates (count), ambiguous."""
    members = members if members is not None else cluster_members(profile)
    dup = duplicates(profile, members).groupBy("root").agg(F.count("*").alias("duplicates"))
    amb = ambiguous_roots(profile, members).select("root", F.lit(True).alias("ambiguous"))
    return (
        cluster_ids(members)
        .join(dup, "root", "left")
        .join(amb, "root", "left")
        .select(
            "cluster_id",
            "root",
            "size",
            F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
            F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        )
    )


def cluster_articles(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Membership as rows (cluster_id, article_id); a cluster is never one long array."""
    return attach_per_key(members, grouped.select("root", "cluster_id", "size"), ["root"], "size").select(
        "cluster_id", "article_id"
    )


def build_decisions(proposals: DataFrame, members: DataFrame, grouped: DataFrame, run_id: str) -> DataFrame:
    """One scored decision per cluster.

    The representative has the best credibility (then the lowest id) and supplies every scalar field;
    list fields are sorted unions; an ambiguous cluster goes to review, its total unchanged.
    """
    p = proposals.join(members, "article_id")
    credibility = F.coalesce(F.col("components")["source_credibility"]["points"], F.lit(0))
    scalar = [
        "article_id", "event_identity", "primary_event_type", "subtype", "primary_region", "relevance_level",
        "components", "gates", "critical_candidate",
    ]
    scalar = [c for c in scalar if c in p.columns]
    primary = first_by(p, ["root"], [-credibility, F.col("article_id")], scalar).withColumnRenamed(
        "article_id", "primary_article_id"
    )
    lists = [c for c in ("direct_entity_ids", "propagated_entity_ids", "asset_classes", "sector_ids", "theme_ids") if c in p.columns]
    unions = None
    for name in lists:
        # Distinct values first: a hot cluster aggregates its few values, not its many rows.
        one = p.select("root", F.explode(name).alias("v")).distinct().groupBy("root").agg(
            F.array_sort(F.collect_list("v")).alias(name)
        )
        unions = one if unions is None else unions.join(one, "root", "full")
    out = grouped.join(primary, "root")
    if unions is not None:
        out = out.join(unions, "root", "left")
        for name in lists:
            out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    out = evaluate_gates(out)
    amb = F.col("ambiguous")
    dup = F.col("duplicates") > 0
    codes = F.col("disposition_reason_codes")
    codes = F.when(amb, F.array_sort(F.array_union(codes, F.array(F.lit("ambiguous_identity"))))).otherwise(codes)
    codes = F.when(dup, F.array_sort(F.array_union(codes, F.array(F.lit("duplicate"))))).otherwise(codes)
    gates = F.transform_values(
        "gates", lambda k, v: F.when(amb & (k == "identity"), F.lit("review_required")).otherwise(v)
    )
    final = F.when(amb, "review_required").otherwise(F.col("recommendation"))
    return out.select(
        F.col("cluster_id").alias("event_id"),
        F.lit(1).alias("revision"),
        F.concat(F.lit(run_id + ":"), "cluster_id").alias("decision_id"),
        F.lit(run_id).alias("run_id"),
        "root",
        "size",
        "primary_article_id",
        *[c for c in scalar if c not in ("article_id", "gates")],
        *lists,
        gates.alias("gates"),
        "total_score",
        final.alias("recommendation"),
        codes.alias("disposition_reason_codes"),
        F.lit("monitored").alias("held_status"),
        F.struct(
            F.when(final.isin(fv.SELECTED_RECOMMENDATIONS), "pending_review").otherwise("not_selected").alias("status"),
            F.lit(None).cast("string").alias("selection_reason"),
        ).alias("publication"),
    )

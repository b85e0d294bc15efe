"""Clusters, decisions, headline overlap, repeated stories, ordering and editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators import clusters, overlap, scoring, stories
from newsloom.operators.skew import first_by
from newsloom.plans.bindings import documents
from newsloom.plans.registry import query, table
from newsloom.plans.text_queries import HEAD_WORDS_SQL, SEARCH_WORDS_SQL
from newsloom.session import cut


def _s(c):
    return c.cast("string")


# --- clusters --------------------------------------------------------------------------------
def proposals(spark, sf):
    """documents as proposals: type, parties, vehicle, period and date follow from doc_id."""
    k = F.col("doc_id")
    aid = F.lpad(_s(k), 9, "0")
    d = documents(spark, sf)
    anchor = lambda name: F.element_at(F.array(*[F.lit(v) for v in fv.ANCHORS[name]]), (k % len(fv.ANCHORS[name]) + 1).cast("int"))
    comp = lambda c: F.struct(c.cast("int").alias("points"), F.lit("r").alias("reason"), F.array().cast("array<string>").alias("evidence_refs"))
    p = d.select(
        aid.alias("article_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("credit_stress", "regulatory", "ratings", "other")]), (k % 4 + 1).cast("int")).alias("primary_event_type"),
        F.lit(None).cast("string").alias("subtype"),
        F.array(F.col("source")).alias("direct_entity_ids"),
        F.array().cast("array<string>").alias("propagated_entity_ids"),
        F.array(F.col("lang")).alias("sector_ids"),
        F.struct(
            F.when(k % 7 == 0, F.array(F.lit("Shared, Party"))).otherwise(F.array().cast("array<string>")).alias("parties"),
            F.lit("a").alias("action"),
            F.when(k % 3 == 0, F.concat(F.lit("Fund "), _s(k % 40))).alias("vehicle"),
            F.when(k % 4 == 1, F.concat(F.lit("Q"), _s(k % 20))).alias("period"),
            F.when(k % 6 == 2, _s(F.date_add(F.lit("2024-01-01").cast("date"), (k % 24).cast("int")))).alias("event_date"),
        ).alias("event_identity"),
        F.when(k % 5 == 0, "A").when(k % 5 == 1, "B").when(k % 5 == 2, "C").when(k % 5 == 3, "A").alias("relevance_level"),
        F.struct(*[comp(anchor(n)).alias(n) for n in fv.COMPONENTS]).alias("components"),
        F.create_map(F.lit("identity"), F.when(k % 13 == 0, "review_required").otherwise("pass"), F.lit("relevance"), F.lit("pass")).alias("gates"),
        (k % 10 == 0).alias("critical_candidate"),
        F.when(k % 9 == 0, "Europe").otherwise("US").alias("primary_region"),
    )
    e = d.select(
        aid.alias("article_id"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.sha2("text", 256).alias("evidence_hash"),
        F.when(k % 50 == 7, F.lpad(_s(k - 3), 9, "0")).alias("supersedes_article_id"),
    )
    return p, e


def _anchor_sql(name):
    values = ", ".join(str(v) for v in fv.ANCHORS[name])
    return f"([{values}])[doc_id % {len(fv.ANCHORS[name])} + 1]"


PROFILE_SQL = """
p AS (SELECT doc_id, lpad(doc_id::varchar, 9, '0') AS id, doc_id % 4 AS type, source,
  CASE WHEN doc_id % 7 = 0 THEN [source, 'shared party'] ELSE [source] END AS parties,
  CASE WHEN doc_id % 3 = 0 THEN 'fund ' || (doc_id % 40) ELSE '' END AS vehicle,
  CASE WHEN doc_id % 4 = 1 THEN 'q' || (doc_id % 20) ELSE '' END AS period,
  CASE WHEN doc_id % 6 = 2 THEN (doc_id % 24)::varchar ELSE '' END AS day, sha256(text) AS h,
  CASE WHEN doc_id % 50 = 7 THEN doc_id - 3 END AS sup FROM documents)
"""
# The pairwise rule itself, over all pairs: brute force, fine at check size.
VERDICT_SQL = f"""
{PROFILE_SQL},
v AS (SELECT a.id AS a, b.id AS b, CASE
    WHEN a.h = b.h THEN 'duplicate'
    WHEN a.sup = b.doc_id OR b.sup = a.doc_id THEN 'same'
    WHEN a.type <> b.type THEN 'distinct'
    WHEN NOT list_has_any(a.parties, b.parties) THEN 'distinct'
    WHEN a.vehicle <> '' AND b.vehicle <> '' THEN CASE WHEN a.vehicle = b.vehicle THEN 'same' ELSE 'distinct' END
    WHEN a.period <> '' AND a.period = b.period THEN 'same'
    WHEN a.day <> '' AND a.day = b.day THEN 'same'
    ELSE 'ambiguous' END AS verdict
  FROM p a JOIN p b ON a.id < b.id),
e AS (SELECT a, b FROM v WHERE verdict IN ('duplicate', 'same') UNION ALL SELECT b, a FROM v WHERE verdict IN ('duplicate', 'same')),
reach AS (SELECT id AS node, id AS root FROM p UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node),
m AS (SELECT node AS article_id, min(root) AS root FROM reach GROUP BY node),
ids AS (SELECT root, 'pe-' || substr(sha256(concat_ws('|', count(*)::varchar, sum(('0x' || substr(sha256(article_id), 1, 16))::hugeint)::varchar, sum(('0x' || substr(sha256(article_id), 17, 16))::hugeint)::varchar, sum(('0x' || substr(sha256(article_id), 33, 16))::hugeint)::varchar, sum(('0x' || substr(sha256(article_id), 49, 16))::hugeint)::varchar)), 1, 12) AS cluster_id, count(*) AS size FROM m GROUP BY root),
dup AS (SELECT DISTINCT x.article_id, x.root FROM m x JOIN v ON v.verdict = 'duplicate' AND (v.a = x.article_id OR v.b = x.article_id) WHERE x.article_id <> x.root),
amb AS (SELECT DISTINCT x.root, y.article_id AS partner FROM v JOIN m x ON x.article_id = v.a JOIN m y ON y.article_id = v.b WHERE v.verdict = 'ambiguous' AND x.root <> y.root
        UNION SELECT DISTINCT y.root, x.article_id FROM v JOIN m x ON x.article_id = v.a JOIN m y ON y.article_id = v.b WHERE v.verdict = 'ambiguous' AND x.root <> y.root)
"""


def _clustered(spark, sf):
    p, e = proposals(spark, sf)
    profile = cut(clusters.link_profile(p, e), "profile")
    members = cut(clusters.cluster_members(profile), "members")
    return p, profile, members


@query(
    "clusters",
    f"""
    WITH RECURSIVE {VERDICT_SQL}
    SELECT cluster_id, root, size, (SELECT count(*) FROM dup WHERE dup.root = ids.root) AS duplicates, root IN (SELECT root FROM amb) AS ambiguous FROM ids
    """,
)
def clusters_query(spark, sf):
    _, profile, members = _clustered(spark, sf)
    return clusters.clusters(profile, members)


@query("cluster_members", f"WITH RECURSIVE {VERDICT_SQL} SELECT cluster_id, article_id FROM m JOIN ids USING (root)")
def cluster_members(spark, sf):
    _, profile, members = _clustered(spark, sf)
    return clusters.cluster_articles(members, clusters.cluster_ids(members))


@query("duplicate_articles", f"WITH RECURSIVE {VERDICT_SQL} SELECT article_id, root FROM dup")
def duplicate_articles(spark, sf):
    _, profile, members = _clustered(spark, sf)
    return clusters.duplicates(profile, members)


@query(
    "ambiguous_partners",
    f"""
    WITH RECURSIVE {VERDICT_SQL}, x AS (SELECT m.root, p.id, p.type, unnest(p.parties) AS party, p.vehicle FROM p JOIN m ON m.article_id = p.id),
    g AS (SELECT x.root, x.type, x.party, bool_or(x.vehicle = '') AS free, count(DISTINCT y.id) AS partners FROM x JOIN x y ON y.type = x.type AND y.party = x.party AND y.root <> x.root
      JOIN v ON v.verdict = 'ambiguous' AND v.a = least(x.id, y.id) AND v.b = greatest(x.id, y.id) GROUP BY x.root, x.type, x.party)
    SELECT x.root, x.id AS article_id, (['credit_stress', 'regulatory', 'ratings', 'other'])[x.type + 1] AS type, x.party, x.vehicle = '' AS open, g.free, g.partners
    FROM x JOIN g ON g.root = x.root AND g.type = x.type AND g.party = x.party
    """,
)
def ambiguous_partners(spark, sf):
    """The partners of every ambiguous cluster, as blocks with their articles in place of pairs; the SQL goes by the pairs."""
    _, profile, members = _clustered(spark, sf)
    return clusters.partner_members(profile, members)


_GATES_SQL = f"""
c AS (SELECT *, fit + mat + tra + act + cre + nov AS total,
  CASE WHEN cre >= 7 THEN 'pass' ELSE 'fail' END AS g_evidence, CASE WHEN mat >= 15 THEN 'pass' ELSE 'fail' END AS g_materiality,
  CASE WHEN tra >= CASE WHEN coalesce(lvl, '') = 'C' THEN 15 ELSE 10 END THEN 'pass' ELSE 'fail' END AS g_transmission,
  CASE WHEN nov >= 2 THEN 'pass' ELSE 'fail' END AS g_novelty, CASE WHEN lvl IS NULL THEN 'fail' ELSE 'pass' END AS g_relevance FROM s),
f AS (SELECT *, list_sort(list_filter([CASE WHEN g_evidence = 'fail' THEN 'insufficient_evidence' END, CASE WHEN g_relevance = 'fail' THEN 'no_relevance' END,
    CASE WHEN g_materiality = 'fail' THEN 'below_materiality' END, CASE WHEN g_transmission = 'fail' THEN 'weak_transmission' END,
    CASE WHEN g_novelty = 'fail' THEN 'no_new_fact' END], lambda x: x IS NOT NULL)) AS fails,
  CASE WHEN total >= 80 THEN 'priority_shortlist' WHEN total >= 70 THEN 'shortlist' WHEN total >= 60 THEN 'reserve_manual_only' ELSE 'suppress' END AS band FROM c),
r AS (SELECT *, CASE WHEN review THEN 'review_required' WHEN len(fails) > 0 THEN 'suppress' ELSE band END AS rec,
  CASE WHEN review THEN CASE WHEN len(fails) > 0 THEN fails ELSE ['conflicting_evidence'] END WHEN len(fails) > 0 THEN fails
       WHEN band IN ('suppress', 'reserve_manual_only') THEN ['below_band'] ELSE ['shortlisted'] END AS codes FROM f),
g AS (SELECT *, CASE WHEN crit AND rec IN ('suppress', 'reserve_manual_only') THEN 'review_required' ELSE rec END AS recommendation,
  CASE WHEN crit THEN list_sort(list_append(codes, 'critical_review')) ELSE codes END AS reason_codes FROM r)
"""
_SCORE_SQL = f"""
s AS (SELECT lpad(doc_id::varchar, 9, '0') AS article_id, doc_id, {_anchor_sql('portfolio_fit')} AS fit, {_anchor_sql('materiality')} AS mat, {_anchor_sql('investment_transmission')} AS tra,
  {_anchor_sql('actionability')} AS act, {_anchor_sql('source_credibility')} AS cre, {_anchor_sql('novelty')} AS nov, doc_id % 13 = 0 AS review,
  CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'A' END AS lvl, doc_id % 10 = 0 AND doc_id % 4 IN (0, 1) AS crit FROM documents)
"""


@query(
    "scoring_gates",
    f"WITH {_SCORE_SQL}, {_GATES_SQL} SELECT article_id, total AS total_score, recommendation, array_to_string(reason_codes, '|') AS codes, "
    "g_evidence || g_relevance || g_materiality || g_transmission || g_novelty AS outcomes FROM g",
)
def scoring_gates(spark, sf):
    p, _ = proposals(spark, sf)
    g = scoring.evaluate_gates(p)
    names = ("evidence", "relevance", "materiality", "transmission", "novelty")
    return g.select(
        "article_id", "total_score", "recommendation", F.array_join("disposition_reason_codes", "|").alias("codes"),
        F.concat(*[F.col("gates")[n] for n in names]).alias("outcomes"),
    )


@query(
    "score_totals",
    f"WITH {_SCORE_SQL} SELECT article_id, CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 1 THEN NULL ELSE fit + mat + tra + act + cre + nov END AS total_score FROM s",
)
def score_totals(spark, sf):
    """A missing anchor (every eighth) or an unconfigured one leaves the total null."""
    p, _ = proposals(spark, sf)
    k = F.col("article_id").cast("long") % 8
    nov = F.when(k == 0, F.lit(None).cast("int")).when(k == 1, 99).otherwise(F.col("components.novelty.points"))
    broken = p.withColumn("components", F.col("components").withField("novelty", F.col("components.novelty").withField("points", nov)))
    return broken.select("article_id", scoring.total_score().alias("total_score"))


@query(
    "decisions",
    f"""
    WITH RECURSIVE {VERDICT_SQL}, raw AS (SELECT * FROM (WITH {_SCORE_SQL} SELECT * FROM s)),
    j AS (SELECT raw.*, m.root FROM raw JOIN m USING (article_id)),
    rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY cre DESC, article_id) AS rn FROM j) WHERE rn = 1),
    s AS (SELECT * FROM rep), {_GATES_SQL}
    SELECT ids.cluster_id AS event_id, g.article_id AS primary_article_id, ids.size, g.total AS total_score,
      CASE WHEN g.root IN (SELECT root FROM amb) THEN 'review_required' ELSE g.recommendation END AS recommendation,
      array_to_string(list_sort(list_distinct(list_concat(g.reason_codes,
        list_concat(CASE WHEN g.root IN (SELECT root FROM amb) THEN ['ambiguous_identity'] ELSE [] END,
                    CASE WHEN g.root IN (SELECT root FROM dup) THEN ['duplicate'] ELSE [] END)))), '|') AS codes
    FROM g JOIN ids USING (root)
    """,
)
def decisions_query(spark, sf):
    p, profile, members = _clustered(spark, sf)
    out = clusters.build_decisions(p, members, clusters.clusters(profile, members), "run-1")
    return out.select("event_id", "primary_article_id", "size", "total_score", "recommendation", F.array_join("disposition_reason_codes", "|").alias("codes"))


# --- overlap ---------------------------------------------------------------------------------
_WORD_COUNT = f"""
w AS (SELECT doc_id AS a, {SEARCH_WORDS_SQL.format(t="split_part(text, '.', 1)")} AS w FROM documents),
b AS (SELECT item_id AS b, {SEARCH_WORDS_SQL.format(t='text')} AS w FROM benchmark)
"""


@query(
    "headline_overlap",
    f"WITH {_WORD_COUNT} SELECT a, b, len(list_intersect(w.w, b.w)) / greatest(1, len(w.w)) AS score FROM w, b WHERE len(list_intersect(w.w, b.w)) / greatest(1, len(w.w)) >= 0.6",
)
def headline_overlap(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), "title")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    return overlap.contained_headlines(d, b)


@query(
    "same_story",
    f"""
    WITH t AS (SELECT doc_id AS id, {HEAD_WORDS_SQL.format(t="split_part(text, '.', 1)")} AS ws FROM documents),
    s AS (SELECT lead, w, min(id) AS sig, count(*) AS headlines FROM (SELECT id, ws[1] AS lead, list_sort(list_distinct(ws)) AS w FROM t WHERE len(ws) > 0) GROUP BY lead, w)
    SELECT x.sig AS sig_a, y.sig AS sig_b, x.headlines AS headlines_a, y.headlines AS headlines_b,
      len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) AS jaccard
    FROM s x JOIN s y ON x.lead = y.lead AND x.sig < y.sig
    WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.5
    """,
)
def same_story(spark, sf):
    return overlap.same_story_pairs(documents(spark, sf).select(F.col("doc_id").alias("id"), "title"))


def _search_results(spark, sf):
    """Four results per document: its own headline, cut headlines, and a blocked host."""
    k = F.col("doc_id")
    d = documents(spark, sf)
    words = F.split("title", " ")
    keep = F.greatest(F.lit(1), F.size(words) - F.col("pos"))
    return d.select(k.alias("card_id"), "title", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select(
        "card_id",
        "pos",
        F.when((F.col("pos") == 0) & (F.col("card_id") % 2 == 0), "https://www.ft.com/a").otherwise(F.concat(F.lit("https://site.example/"), _s(F.col("pos")))).alias("url"),
        F.array_join(F.slice(words, F.lit(1), keep.cast("int")), " ").alias("title"),
    )


_RESULTS_SQL = f"""
r AS (SELECT doc_id AS card_id, pos, {SEARCH_WORDS_SQL.format(t='title')} AS wanted,
  CASE WHEN pos = 0 AND doc_id % 2 = 0 THEN 'https://www.ft.com/a' ELSE 'https://site.example/' || pos END AS url,
  {SEARCH_WORDS_SQL.format(t="array_to_string(string_split(title, ' ')[1:greatest(1, len(string_split(title, ' ')) - pos)], ' ')")} AS found
  FROM (SELECT doc_id, split_part(text, '.', 1) AS title, unnest([0, 1, 2, 3]) AS pos FROM documents)),
q AS (SELECT card_id, pos, url, len(list_intersect(wanted, found)) / greatest(1, len(wanted)) AS score FROM r WHERE url <> 'https://www.ft.com/a')
"""


@query("best_candidate", f"WITH {_RESULTS_SQL} SELECT card_id, url, score FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, url DESC) AS rn FROM q WHERE score >= 0.6) WHERE rn = 1")
def best_candidate(spark, sf):
    cards = documents(spark, sf).select(F.col("doc_id").alias("card_id"), F.col("title").alias("headline"))
    return overlap.best_candidate(cards, _search_results(spark, sf))


@query(
    "top_candidates",
    f"WITH {_RESULTS_SQL} SELECT card_id, rn AS rank, url, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, pos) AS rn FROM q WHERE score >= 0.8) WHERE rn <= 3",
)
def top_candidates(spark, sf):
    cards = documents(spark, sf).select(F.col("doc_id").alias("card_id"), F.col("title").alias("headline"))
    return overlap.top_candidates(cards, _search_results(spark, sf)).select("card_id", "rank", "url", "score")


_VERIFY_SQL = f"""
WITH {_RESULTS_SQL}, o AS (SELECT card_id, pos + 1 AS rank, len(list_intersect(wanted, found)) / greatest(1, len(wanted)) AS title_score FROM r WHERE pos < 3)
SELECT card_id, rank, CASE WHEN card_id % 7 = 0 THEN 'http_error' WHEN title_score >= 0.8 AND card_id % 5 = 0 THEN 'review_date'
  WHEN title_score >= 0.8 AND card_id % 5 < 3 THEN 'verified' ELSE 'mismatch' END AS verdict FROM o
"""


def _verified(spark, sf):
    r = _search_results(spark, sf).withColumnRenamed("title", "page_title")
    d = documents(spark, sf).select(F.col("doc_id").alias("card_id"), F.col("title").alias("headline"), F.col("day").alias("card_date"))
    k = F.col("card_id")
    o = r.join(d, "card_id").select(
        "card_id", (F.col("pos") + 1).alias("rank"), "headline", "card_date", F.when(k % 7 == 0, "headline_only").otherwise("excerpt").alias("level"),
        F.when(k % 7 == 0, "http_error").otherwise("fetched").alias("status"), "page_title",
        F.when(k % 5 != 0, _s(F.date_add("card_date", F.when(k % 5 < 3, 7).otherwise(8).cast("int")))).alias("source_published_at"),
    )
    return overlap.verify_sources(o)


@query("verify_sources", _VERIFY_SQL)
def verify_sources(spark, sf):
    return _verified(spark, sf).select("card_id", "rank", "verdict")


@query("best_source", f"SELECT card_id, min(rank) AS rank FROM ({_VERIFY_SQL}) WHERE verdict = 'verified' GROUP BY card_id")
def best_source(spark, sf):
    return overlap.best_source(_verified(spark, sf)).select("card_id", "rank")


# --- repeated stories ------------------------------------------------------------------------
_STORY_SQL = """
WITH RECURSIVE e AS (SELECT event_id, event_type || (user_id % 8) AS head, ts FROM events),
a AS (SELECT head, min(ts) AS anchor FROM e GROUP BY head
      UNION ALL SELECT a.head, (SELECT min(e.ts) FROM e WHERE e.head = a.head AND e.ts > a.anchor + INTERVAL 7 DAY) FROM a WHERE a.anchor IS NOT NULL),
k AS (SELECT * FROM a WHERE anchor IS NOT NULL),
n AS (SELECT k.head, k.anchor, min(e.event_id) AS story FROM k JOIN e ON e.head = k.head AND e.ts = k.anchor GROUP BY ALL)
SELECT e.event_id AS id, n.story FROM e JOIN n ON n.head = e.head AND e.ts >= n.anchor AND e.ts <= n.anchor + INTERVAL 7 DAY
"""


def _story_cards(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat("event_type", _s(F.col("user_id") % 8)).alias("head"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    )


@query("headline_anchor_7d", _STORY_SQL)
def headline_anchor_7d(spark, sf):
    return stories.headline_stories(_story_cards(spark, sf))


@query("headline_anchor_hot", _STORY_SQL)
def headline_anchor_hot(spark, sf):
    """The same rows under the name of the former hot-headline path; one path serves all heads now."""
    return stories.headline_stories(_story_cards(spark, sf))


@query(
    "reviewed_anchor_join",
    """
    WITH e AS (SELECT event_id, event_type || (user_id % 8) AS head, ts FROM events), r AS (SELECT * FROM e WHERE event_id % 97 = 0)
    SELECT id, story FROM (
      SELECT e.event_id AS id, 's' || r.event_id AS story, row_number() OVER (PARTITION BY e.event_id ORDER BY r.ts, r.event_id) AS rn
      FROM e JOIN r ON r.head = e.head AND e.ts BETWEEN r.ts - INTERVAL 7 DAY AND r.ts + INTERVAL 7 DAY WHERE e.event_id % 97 <> 0) WHERE rn = 1
    """,
)
def reviewed_anchor_join(spark, sf):
    c = _story_cards(spark, sf)
    reviewed = c.filter(F.col("id") % 97 == 0).withColumn("story", F.concat(F.lit("s"), _s(F.col("id"))))
    return stories.reviewed_anchor_hits(c.filter(F.col("id") % 97 != 0), reviewed, stories.WINDOW)


# --- ordering and editions -------------------------------------------------------------------
def order_decisions(spark, sf):
    """orders as decisions: score from the price, one edition per order date."""
    k = F.col("o_orderkey")
    score = (F.floor(F.col("o_totalprice")) % 41 + 60).cast("int")
    rec = scoring.band(score)
    crit = k % 37 == 0
    return table(spark, sf, "orders").select(
        F.lpad(_s(k), 9, "0").alias("event_id"),
        F.when(k % 101 != 0, F.to_date("o_orderdate")).alias("day"),
        (F.col("o_custkey") % 3).cast("int").alias("desk"),
        score.alias("total_score"),
        F.when(crit & (rec == "reserve_manual_only"), "review_required").otherwise(rec).alias("recommendation"),
        F.when(F.col("o_custkey") % 4 == 0, "Europe").otherwise("US").alias("primary_region"),
        F.when(crit, F.array(F.lit("critical_review"))).otherwise(F.array(F.lit("shortlisted"))).alias("disposition_reason_codes"),
    )


ORDER_SQL = """
d0 AS (SELECT lpad(o_orderkey::varchar, 9, '0') AS event_id, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate::date END AS day, o_custkey % 3 AS desk,
  (floor(o_totalprice)::bigint % 41 + 60)::int AS score, o_custkey % 4 = 0 AS eu, o_orderkey % 37 = 0 AS crit FROM orders),
d AS (SELECT *, CASE WHEN score >= 80 THEN 'priority_shortlist' WHEN score >= 70 THEN 'shortlist' WHEN crit THEN 'review_required' ELSE 'reserve_manual_only' END AS rec FROM d0)
"""


def _pass_sql(scope):
    """The left-to-right pass itself, one step per row, with the held element carried along."""
    keys = ", ".join(scope) if scope else "1"
    same = " AND ".join(f"b.{c} IS NOT DISTINCT FROM s.{c}" for c in scope) or "TRUE"
    cols = "".join(f", {c}" for c in scope)
    scols = "".join(f", s.{c}" for c in scope)
    swap = "NOT s.h_crit AND NOT b.crit AND s.h_rec = b.rec AND s.h_score - b.score <= 5 AND b.eu AND NOT s.h_eu"
    return f"""
b AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY crit DESC, score DESC, event_id) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM src),
s AS (SELECT i{cols}, n, event_id AS h_id, crit AS h_crit, rec AS h_rec, score AS h_score, eu AS h_eu, NULL::varchar AS out_id FROM b WHERE i = 1
  UNION ALL
  SELECT b.i{scols}, s.n, CASE WHEN {swap} THEN s.h_id ELSE b.event_id END, CASE WHEN {swap} THEN s.h_crit ELSE b.crit END, CASE WHEN {swap} THEN s.h_rec ELSE b.rec END,
    CASE WHEN {swap} THEN s.h_score ELSE b.score END, CASE WHEN {swap} THEN s.h_eu ELSE b.eu END, CASE WHEN {swap} THEN b.event_id ELSE s.h_id END
  FROM s JOIN b ON {same} AND b.i = s.i + 1),
pos AS (SELECT out_id AS event_id, i - 1 AS tie_rank FROM s WHERE out_id IS NOT NULL UNION ALL SELECT h_id, i FROM s WHERE i = n),
ranked AS (SELECT b.*, b.i AS base_rank, pos.tie_rank FROM b JOIN pos USING (event_id))
"""


@query("europe_tiebreak", f"WITH RECURSIVE {ORDER_SQL}, src AS (SELECT * FROM d), {_pass_sql(['day'])} SELECT event_id, day, base_rank, tie_rank AS position FROM ranked")
def europe_tiebreak(spark, sf):
    return scoring.rank_decisions(order_decisions(spark, sf), ["day"]).select("event_id", "day", "base_rank", "position")


@query(
    "tiebreak_by_desk",
    f"WITH RECURSIVE {ORDER_SQL}, src AS (SELECT *, desk AS d1 FROM d), {_pass_sql(['desk'])} SELECT event_id, desk, base_rank, tie_rank AS position FROM ranked",
)
def tiebreak_by_desk(spark, sf):
    """Three scopes only, each a third of all rows."""
    return scoring.rank_decisions(order_decisions(spark, sf), ["desk"]).select("event_id", "desk", "base_rank", "position")


@query(
    "global_rank_by_share",
    f"WITH {ORDER_SQL} SELECT event_id, row_number() OVER (ORDER BY crit DESC, score DESC, event_id) AS position FROM d",
)
def global_rank_by_share(spark, sf):
    """Europe already holds its share of the history, so the tie-break is off."""
    d = order_decisions(spark, sf)
    return scoring.rank_decisions(d, history=d).select("event_id", "position")


@query("europe_share", f"WITH {ORDER_SQL} SELECT round(avg(eu::int), 9) AS europe_share FROM d")
def europe_share(spark, sf):
    return scoring.europe_share(order_decisions(spark, sf)).select(F.round("europe_share", 9).alias("europe_share"))


_SLOT = "CASE WHEN crit AND NOT listed THEN 'urgent_review' WHEN listed AND (k <= 10 OR crit) THEN 'selected' WHEN listed THEN 'overflow' ELSE 'none' END"


@query(
    "edition_by_desk",
    f"""
    WITH RECURSIVE {ORDER_SQL}, src AS (SELECT * FROM d), {_pass_sql(['desk'])},
    l AS (SELECT *, rec IN ('priority_shortlist', 'shortlist') AS listed FROM ranked),
    k AS (SELECT *, sum(listed::int) OVER (PARTITION BY desk ORDER BY tie_rank) AS k FROM l)
    SELECT event_id, desk, {_SLOT} AS slot FROM k
    """,
)
def edition_by_desk(spark, sf):
    ranked = scoring.rank_decisions(order_decisions(spark, sf), ["desk"])
    return scoring.select_edition(ranked, ["desk"]).select("event_id", "desk", "slot")


_BY_DAY_SQL = f"""
WITH RECURSIVE {ORDER_SQL}, src AS (SELECT * FROM d WHERE day IS NOT NULL), {_pass_sql(['day'])},
l AS (SELECT *, rec IN ('priority_shortlist', 'shortlist') AS listed FROM ranked),
kk AS (SELECT *, sum(listed::int) OVER (PARTITION BY day ORDER BY tie_rank) AS kt, sum(listed::int) OVER (PARTITION BY day ORDER BY base_rank) AS kp FROM l),
sl AS (SELECT *, {_SLOT.replace('k <=', 'kt <=')} AS slot_t, {_SLOT.replace('k <=', 'kp <=')} AS slot_p FROM kk),
dd AS (SELECT day, row_number() OVER (ORDER BY day) AS j, count(*) FILTER (WHERE slot_t = 'selected') AS nt, count(*) FILTER (WHERE slot_t = 'selected' AND eu) AS et,
  count(*) FILTER (WHERE slot_p = 'selected') AS np, count(*) FILTER (WHERE slot_p = 'selected' AND eu) AS ep FROM sl GROUP BY day),
roll AS (SELECT 0::bigint AS j, 5::bigint AS n, 1::bigint AS e, FALSE AS on_
  UNION ALL SELECT dd.j, roll.n + CASE WHEN roll.e / roll.n < 0.2 THEN nt ELSE np END, roll.e + CASE WHEN roll.e / roll.n < 0.2 THEN et ELSE ep END, roll.e / roll.n < 0.2
  FROM roll JOIN dd ON dd.j = roll.j + 1)
SELECT sl.event_id, sl.day, CASE WHEN on_ THEN tie_rank ELSE base_rank END AS position, CASE WHEN on_ THEN slot_t ELSE slot_p END AS slot
FROM sl JOIN dd USING (day) JOIN roll USING (j)
UNION ALL SELECT event_id, NULL, NULL, 'undated' FROM d WHERE day IS NULL
"""


def _by_day(spark, sf):
    return scoring.editions_by_day(order_decisions(spark, sf), prior=(5, 1))


@query("edition_per_day", _BY_DAY_SQL)
def edition_per_day(spark, sf):
    return _by_day(spark, sf).select("event_id", "day", "position", "slot")


@query(
    "edition_summary",
    f"""SELECT day, count(*) FILTER (WHERE slot = 'selected') AS selected, count(*) FILTER (WHERE slot = 'overflow') AS overflow,
    count(*) FILTER (WHERE slot = 'urgent_review') AS urgent_review, count(*) FILTER (WHERE slot = 'selected') < 6 AS below_target FROM ({_BY_DAY_SQL}) GROUP BY day""",
)
def edition_summary(spark, sf):
    return scoring.edition_summary(_by_day(spark, sf), ["day"])


@query(
    "rank_ablation",
    f"""WITH {_SCORE_SQL}, {_GATES_SQL} SELECT article_id AS event_id,
    row_number() OVER (ORDER BY list_contains(reason_codes, 'critical_review') DESC, mat DESC, tra DESC, fit DESC, article_id) AS position FROM g""",
)
def rank_ablation(spark, sf):
    p, _ = proposals(spark, sf)
    g = scoring.evaluate_gates(p).withColumnRenamed("article_id", "event_id")
    return scoring.rank_all(g, scoring.ablation_order(), [], "position").select("event_id", "position")


_BUCKET_SQL = "CASE rec WHEN 'review_required' THEN 'review' WHEN 'reserve_manual_only' THEN 'reserve' WHEN 'suppress' THEN 'suppressed' ELSE 'shortlisted' END"


@query(
    "queue_explained",
    f"""
    WITH {ORDER_SQL}, q AS (SELECT *, {_BUCKET_SQL} AS bucket FROM d)
    SELECT event_id, bucket, score || ' is in ' || CASE WHEN score >= 80 THEN '80–100 (priority_shortlist)' WHEN score >= 70 THEN '70–79 (shortlist)' ELSE '60–69 (reserve_manual_only)' END AS score_band,
      CASE WHEN crit THEN 'critical_review: always surfaced' WHEN rec = 'review_required' THEN 'shortlisted: a person decides' ELSE 'shortlisted: passed' END AS reason,
      row_number() OVER (ORDER BY list_position(['shortlisted', 'reserve', 'review', 'suppressed'], bucket), score DESC, event_id) AS place
    FROM q
    """,
)
def queue_explained(spark, sf):
    texts = spark.createDataFrame(
        [("critical_review", None, "always surfaced"), ("shortlisted", None, "passed"), ("shortlisted", "review_required", "a person decides")],
        "code string, recommendation string, explanation string",
    )
    d = order_decisions(spark, sf).withColumn("gates", F.create_map(F.lit("evidence"), F.lit("pass")))
    x = scoring.explain(d, texts)
    ranked = scoring.rank_all(x, scoring.queue_order(), [], "place")
    return ranked.select("event_id", "bucket", "score_band", F.concat(F.col("reasons")[0]["code"], F.lit(": "), F.col("reasons")[0]["explanation"]).alias("reason"), "place")


@query("queue_counts", f"WITH {ORDER_SQL} SELECT {_BUCKET_SQL} AS bucket, count(*) AS n FROM d GROUP BY 1")
def queue_counts(spark, sf):
    from newsloom.functions.money import lookup

    return order_decisions(spark, sf).groupBy(lookup(fv.QUEUE_BUCKETS, F.col("recommendation")).alias("bucket")).agg(F.count("*").alias("n"))


@query("run_report", f"WITH {ORDER_SQL} SELECT rec AS recommendation, count(*) AS n FROM d GROUP BY 1")
def run_report(spark, sf):
    return order_decisions(spark, sf).groupBy("recommendation").agg(F.count("*").alias("n"))


@query(
    "group_by_date",
    f"WITH {ORDER_SQL} SELECT day, count(*) AS decisions, min(event_id) AS first_id FROM d GROUP BY day",
)
def group_by_date(spark, sf):
    return order_decisions(spark, sf).groupBy("day").agg(F.count("*").alias("decisions"), F.min("event_id").alias("first_id"))


@query(
    "decision_dates",
    "SELECT l_orderkey AS event_id, min(l_shipdate)::date AS date FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_orderkey",
)
def decision_dates(spark, sf):
    """Publication date of a decision: the earliest known date of its items."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate")).alias("date"))
    return li.groupBy("event_id").agg(F.min("date").alias("date")).filter(F.col("date").isNotNull())


@query(
    "decision_sources",
    "SELECT o_orderkey AS event_id, l_partkey AS article_id, p_name AS publisher FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10",
)
def decision_sources(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("article_id"))
    p = table(spark, sf, "part").filter(F.col("p_size") > 10).select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("publisher"))
    return o.join(li, "event_id").join(p, "article_id", "left")


@query(
    "best_by_credibility",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1",
)
def best_by_credibility(spark, sf):
    d = table(spark, sf, "documents")
    return first_by(d, ["source"], [-F.col("n_chars"), F.col("doc_id")], ["doc_id"])

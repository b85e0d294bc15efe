"""Cards to events: overlay, buckets, ids, representatives, priority, ranks and reader views."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import priority, times
from newsloom.functions.identity import display_tags
from newsloom.operators import entries, events, views
from newsloom.plans.bindings import documents
from newsloom.plans.registry import query, table
from newsloom.schemas import IDENTITY
from newsloom.session import cut

AS_OF = "2024-03-05T08:00:00+00:00"


def _s(c):
    return c.cast("string")


def _pick(values, i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def assessment(k):
    """An assessment struct that follows from a key; every fourth card is unread."""
    ok = k % 4 != 0
    deadline = F.when(k % 5 == 0, F.concat(F.lit("2024-03-0"), _s(k % 9 + 1), F.lit("T08:00:00+00:00")))
    return F.struct(
        F.lit("priority-v1").alias("version"),
        ok.alias("assessable"),
        (k % 12 == 0).alias("potential_urgent"),
        F.create_map().cast("map<string,struct<start:int,end:int>>").alias("evidence_refs"),
        F.lit(None).cast("string").alias("source_sha256"),
        F.when(~ok, F.lit("Missing or insufficient source evidence")).alias("failure"),
        F.when(ok, _pick(["critical", "substantial", "bounded"], k % 3)).alias("severity"),
        F.when(ok, _pick(["direct", "sector", "indirect"], F.floor(k / 2) % 3)).alias("linkage"),
        F.when(ok, k % 2 == 0).alias("current_adverse"),
        F.when(ok, k % 7 == 0).alias("resolved"),
        F.when(ok, deadline).alias("deadline_at"),
        F.when(ok, F.when(k % 3 == 0, "primary").otherwise("reported")).alias("evidence_strength"),
        F.when(ok, k % 6 == 3).alias("routine"),
        F.struct(F.when(ok, "why").alias("en"), F.when(ok, "原因").alias("zh")).alias("reason"),
    )


ASSESS_SQL = """
doc_id % 4 <> 0 AS assessable, doc_id % 12 = 0 AS pot,
['critical', 'substantial', 'bounded'][doc_id % 3 + 1] AS severity, ['direct', 'sector', 'indirect'][(doc_id // 2) % 3 + 1] AS linkage,
doc_id % 2 = 0 AS adverse, doc_id % 7 = 0 AS resolved,
CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-03-01 08:00:00' + INTERVAL 1 DAY * (doc_id % 9) END AS deadline,
CASE WHEN doc_id % 3 = 0 THEN 'primary' ELSE 'reported' END AS strength, doc_id % 6 = 3 AS routine0
"""


def _class_sql(src, as_of):
    """Priority columns of an assessed row set at an instant expression."""
    return f"""
SELECT *, CASE WHEN NOT assessable THEN 'needs_review'
    WHEN (severity = 'critical' AND adverse AND NOT resolved) OR (severity IN ('critical', 'substantial') AND bucket <> 'monitor' AND NOT resolved) THEN 'urgent'
    WHEN severity IN ('critical', 'substantial') THEN 'important' ELSE 'useful' END AS priority,
  CASE WHEN assessable THEN severity ELSE 'unknown' END AS sev, CASE WHEN assessable THEN linkage ELSE 'unknown' END AS link,
  CASE WHEN assessable THEN strength ELSE 'unknown' END AS str, assessable AND routine0 AND strength = 'primary' AS routine,
  CASE WHEN assessable THEN bucket ELSE 'monitor' END AS timing
FROM (SELECT *, CASE WHEN hours BETWEEN 0 AND 48 THEN '48h' WHEN hours > 48 AND hours <= 168 THEN '7d' ELSE 'monitor' END AS bucket
      FROM (SELECT *, epoch(deadline - ({as_of})) / 3600 AS hours FROM ({src})))"""


_RANK_ORDER = (
    "list_position(['urgent', 'important', 'useful', 'needs_review'], priority), list_position(['critical', 'substantial', 'bounded', 'unknown'], sev), routine, "
    "list_position(['48h', '7d', 'monitor'], timing), list_position(['direct', 'sector', 'indirect', 'unknown'], link), list_position(['primary', 'reported', 'unknown'], str)"
)


@query(
    "priority_class",
    f"SELECT doc_id, priority, sev AS severity, timing AS time_sensitivity, link AS linkage, str AS evidence_strength, routine, NOT assessable AND pot AS potential_urgent FROM ("
    + _class_sql(f"SELECT doc_id, {ASSESS_SQL} FROM documents", "TIMESTAMP '2024-03-05 08:00:00'") + ")",
)
def priority_class(spark, sf):
    p = priority.classify(assessment(F.col("doc_id")), F.to_timestamp(F.lit(AS_OF)))
    return documents(spark, sf).select("doc_id", p.alias("p")).select(
        "doc_id", *[F.col(f"p.{f}") for f in ("priority", "severity", "time_sensitivity", "linkage", "evidence_strength", "routine", "potential_urgent")]
    )


def cards(spark, sf):
    """documents as cards; copies of a headline, source versions, identities and revisions all occur."""
    k = F.col("doc_id")
    d = documents(spark, sf)
    headline = F.when(F.length("title") > 0, F.concat("title", F.when(k % 4 != 1, " Q1").otherwise(""))).otherwise("x Q2")
    stamp = F.concat(_s(F.col("day")), F.lit("T0"), _s(k % 10), F.lit(":30:00+00:00"))
    ident = F.struct(
        F.lit("subject").alias("subject"), F.col("source").alias("action"), F.lit("deal").alias("object"), _s(k % 3).alias("period"),
        F.array(F.lit("5")).alias("numbers"), F.lit("identity-v1").alias("version"),
    )
    return d.select(
        F.lpad(_s(k), 9, "0").alias("id"),
        F.col("day").alias("date"),
        F.when(k % 9 != 0, stamp).alias("published_at"),
        F.struct(headline.alias("en"), F.lit("标题").alias("zh")).alias("headline"),
        F.struct(F.col("text").alias("en"), F.lit("摘要").alias("zh")).alias("summary"),
        F.array(F.col("lang")).alias("gps"),
        F.array(F.col("source")).alias("sectors"),
        F.lit("US").alias("region"),
        F.struct(F.col("source").alias("publisher"), F.concat(F.lit("https://site.example/"), _s(F.floor(k / 3)), F.lit("?utm_x=1")).alias("url")).alias("source"),
        F.when(k % 20 == 0, "reviewed").otherwise("unreviewed").alias("review_status"),
        F.lit("auto_fetch").alias("origin"),
        F.when(k % 4 != 1, headline).alias("source_headline"),
        F.when(k % 8 == 1, F.sha2("text", 256)).alias("source_fingerprint"),
        assessment(k).alias("assessment"),
        F.when(k % 8 == 5, ident).cast(IDENTITY).alias("event_identity"),
        F.when(k % 3 == 2, F.concat(F.lit("2024-03-01T0"), _s(k % 10), F.lit(":00:00+00:00"))).alias("observed_at"),
        F.when((k % 3 == 2) & (k % 4 == 1), F.lpad(_s(k - 1), 9, "0")).alias("supersedes_card_id"),
        (k % 2 == 0).alias("material_update_confirmed"),
        F.lit("h").alias("card_sha256"),
    )


_STRIPPED = "length(trim(text))"
CARD_SQL = f"""
c0 AS (SELECT doc_id, lpad(doc_id::varchar, 9, '0') AS id, DATE '2024-01-01' + (doc_id % 60)::int AS date, text, lang, source,
  CASE WHEN length(split_part(text, '.', 1)) > 0 THEN split_part(text, '.', 1) || CASE WHEN doc_id % 4 <> 1 THEN ' Q1' ELSE '' END ELSE 'x Q2' END AS h,
  CASE WHEN doc_id % 9 <> 0 THEN strftime(DATE '2024-01-01' + (doc_id % 60)::int, '%Y-%m-%d') || 'T0' || (doc_id % 10) || ':30:00+00:00'
       ELSE strftime(DATE '2024-01-01' + (doc_id % 60)::int, '%Y-%m-%d') || 'T00:00:00+08:00' END AS stamp,
  CASE WHEN doc_id % 9 <> 0 THEN (DATE '2024-01-01' + (doc_id % 60)::int)::timestamp + INTERVAL 1 HOUR * (doc_id % 10) + INTERVAL 30 MINUTE
       ELSE (DATE '2024-01-01' + (doc_id % 60)::int)::timestamp - INTERVAL 8 HOUR END AS t,
  doc_id // 3 AS url, doc_id % 20 = 0 AS reviewed, doc_id % 3 = 2 AND doc_id % 4 = 1 AS revises,
  TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 1 HOUR * (doc_id % 10) AS obs, {ASSESS_SQL} FROM documents),
c AS (SELECT *, CASE WHEN doc_id % 4 <> 1 THEN trim(regexp_replace(replace(lower(h), 'ß', 'ss'), '\\s+', ' ', 'g')) END AS head,
  CASE WHEN doc_id % 8 = 5 THEN 'identity|' || source || '|' || (doc_id % 3) WHEN doc_id % 8 = 1 THEN 'source|' || url || '|' || sha256(text) ELSE 'single|' || id END AS auto FROM c0),
an AS (SELECT head, min(t) AS anchor FROM c WHERE head IS NOT NULL GROUP BY head
  UNION ALL SELECT an.head, (SELECT min(c.t) FROM c WHERE c.head = an.head AND c.t > an.anchor + INTERVAL 7 DAY) FROM an WHERE an.anchor IS NOT NULL),
st AS (SELECT an.head, an.anchor, min(c.id) AS story FROM an JOIN c ON c.head = an.head AND c.t = an.anchor GROUP BY ALL),
bk AS (SELECT c.*, coalesce('headline|' || st.story, c.auto) AS bucket0 FROM c LEFT JOIN st ON st.head = c.head AND c.t >= st.anchor AND c.t <= st.anchor + INTERVAL 7 DAY),
-- A revision follows its parent when both share the URL and identities agree (or headlines are equal).
rv AS (SELECT x.bucket0 AS a, y.bucket0 AS b FROM bk x JOIN bk y ON x.revises AND y.doc_id = x.doc_id - 1 AND x.url = y.url
  WHERE x.bucket0 <> y.bucket0 AND x.doc_id % 8 = 5 AND y.doc_id % 8 = 5 AND x.source = y.source AND x.doc_id % 3 = y.doc_id % 3),
ev AS (SELECT bk.*, coalesce(rv.b, bk.bucket0) AS bucket FROM bk LEFT JOIN (SELECT a, min(b) AS b FROM rv GROUP BY a) rv ON rv.a = bk.bucket0),
fi AS (SELECT bucket, 'evt-' || arg_min(id, (t, id)) AS event_id, arg_min(auto, (t, id)) AS first_auto, count(*) AS n FROM ev GROUP BY bucket),
m AS (SELECT ev.*, fi.event_id, CASE WHEN split_part(bucket, '|', 1) = 'headline' AND n = 1 THEN split_part(first_auto, '|', 1) ELSE split_part(bucket, '|', 1) END AS merge_rule,
  (NOT reviewed, NOT assessable, -{_STRIPPED}, t, id) AS rep FROM ev JOIN fi USING (bucket))
"""


def _pick_sql(keys):
    """Chosen and priority-source card per key set."""
    return f"""(SELECT {keys}, count(*) AS members, arg_min(id, (t, id)) AS first_id,
      coalesce(arg_max(id, (obs0, id)) FILTER (WHERE revises), arg_min(id, rep)) AS representative_card_id, bool_or(revises) AS updated,
      arg_min(id, rep) FILTER (WHERE assessable) AS supported FROM (SELECT *, CASE WHEN doc_id % 3 = 2 THEN obs ELSE t END AS obs0 FROM m) GROUP BY {keys})"""


_EVENT_ROWS = f"""
e AS (SELECT p.*, CASE WHEN r.assessable THEN p.representative_card_id ELSE coalesce(p.supported, p.representative_card_id) END AS priority_source_card_id,
    f.stamp AS first_seen_at, f.t AS material_t, f.merge_rule, r.lang AS gps, r.source AS sectors
  FROM {_pick_sql('event_id')} p JOIN m r ON r.id = p.representative_card_id JOIN m f ON f.id = p.first_id),
x AS ({_class_sql("SELECT e.event_id, e.members, e.representative_card_id, e.priority_source_card_id, e.first_seen_at, CASE WHEN lr.lid IS NOT NULL AND lr.ok AND lr.lobs > e.material_t THEN lr.lobs ELSE e.material_t END AS material_t, e.merge_rule, e.updated, e.gps, e.sectors, s.assessable, s.pot, s.severity, s.linkage, s.adverse, s.resolved, s.deadline, s.strength, s.routine0 FROM e JOIN c s ON s.id = e.priority_source_card_id LEFT JOIN (SELECT event_id, arg_max(id, (obs, id)) AS lid, arg_max(doc_id % 2 = 0, (obs, id)) AS ok, max(obs) AS lobs FROM m WHERE revises GROUP BY event_id) lr USING (event_id)", "TIMESTAMP '2024-03-05 08:00:00'")})
"""


def placed(spark, sf):
    return events.place_cards(cards(spark, sf))


@query(
    "event_projection",
    f"""
    WITH RECURSIVE {CARD_SQL}, {_EVENT_ROWS}
    SELECT event_id, members, representative_card_id, priority_source_card_id, first_seen_at, epoch_us(material_t) AS material_t, merge_rule, updated, priority, timing AS time_sensitivity,
      gps AS display_gps, row_number() OVER (ORDER BY {_RANK_ORDER}, material_t DESC, event_id) AS priority_rank FROM x
    """,
)
def event_projection(spark, sf):
    """The flagship: cards to ranked events."""
    out = events.rank_events(events.events(placed(spark, sf), F.to_timestamp(F.lit(AS_OF))))
    return out.select(
        "event_id", "members", "representative_card_id", "priority_source_card_id", "first_seen_at", "material_t", "merge_rule", "updated",
        F.col("priority.priority").alias("priority"), F.col("priority.time_sensitivity").alias("time_sensitivity"),
        F.array_join("display_gps", "|").alias("display_gps"), "priority_rank",
    )


_DAY_ROWS = f"""
dp AS (SELECT p.*, CASE WHEN r.assessable THEN p.representative_card_id ELSE coalesce(p.supported, p.representative_card_id) END AS src, r.lang AS gps FROM {_pick_sql('event_id, date')} p JOIN m r ON r.id = p.representative_card_id),
dx AS ({_class_sql("SELECT dp.event_id, dp.date, dp.members, dp.representative_card_id, dp.src AS priority_source_card_id, dp.gps, fd.date <> dp.date AS further_coverage, s.assessable, s.pot, s.severity, s.linkage, s.adverse, s.resolved, s.deadline, s.strength, s.routine0 FROM dp JOIN c s ON s.id = dp.src JOIN (SELECT event_id, arg_min(date, (t, id)) AS date FROM m GROUP BY event_id) fd USING (event_id)", "date::timestamp + INTERVAL 15 HOUR + INTERVAL 59 MINUTE + INTERVAL 59 SECOND")})
"""


@query(
    "event_days",
    f"""
    WITH RECURSIVE {CARD_SQL}, {_EVENT_ROWS}, {_DAY_ROWS}
    SELECT dx.event_id, dx.date, dx.members, dx.representative_card_id, dx.priority_source_card_id, dx.further_coverage, dx.priority, dx.gps AS display_gps,
      row_number() OVER (PARTITION BY dx.date ORDER BY {_RANK_ORDER.replace('priority)', 'dx.priority)').replace(', sev)', ', dx.sev)').replace(', routine,', ', dx.routine,').replace(', timing)', ', dx.timing)').replace(', link)', ', dx.link)').replace(', str)', ', dx.str)')},
        x.material_t DESC, dx.event_id) AS priority_rank
    FROM dx JOIN x USING (event_id)
    """,
)
def event_days(spark, sf):
    p = placed(spark, sf)
    out = events.rank_event_days(events.event_days(p), events.events(p, F.to_timestamp(F.lit(AS_OF))))
    return out.select(
        "event_id", "date", "members", "representative_card_id", "priority_source_card_id", "further_coverage", F.col("priority.priority").alias("priority"),
        F.array_join("display_gps", "|").alias("display_gps"), "priority_rank",
    )


@query("event_members", f"WITH RECURSIVE {CARD_SQL} SELECT event_id, id AS card_id, date, stamp, source AS publisher FROM m")
def event_members(spark, sf):
    return events.event_members(placed(spark, sf)).select("event_id", "card_id", "date", "stamp", "publisher")


@query(
    "carried_event_ids",
    f"""
    WITH RECURSIVE {CARD_SQL},
    pr AS (SELECT id, 'old' || (doc_id // 6) AS prior_id FROM c WHERE doc_id % 2 = 0),
    wi AS (SELECT m.event_id AS own, pr.prior_id, min((m.t, m.id)) AS mk FROM m JOIN pr USING (id) GROUP BY ALL),
    bo AS (SELECT event_id AS own, min((t, id)) AS bk FROM m GROUP BY event_id),
    pa AS (SELECT own, prior_id, row_number() OVER (ORDER BY bk, mk, prior_id) AS i FROM wi JOIN bo USING (own)),
    gr AS (SELECT 0::bigint AS i, []::varchar[] AS ul, []::varchar[] AS ur
      UNION ALL SELECT pa.i, CASE WHEN list_contains(ul, own) OR list_contains(ur, prior_id) THEN ul ELSE list_append(ul, own) END,
        CASE WHEN list_contains(ul, own) OR list_contains(ur, prior_id) THEN ur ELSE list_append(ur, prior_id) END FROM gr JOIN pa ON pa.i = gr.i + 1),
    la AS (SELECT unnest(ul) AS own, unnest(ur) AS prior_id FROM gr WHERE i = (SELECT max(i) FROM gr))
    SELECT m.id AS card_id, coalesce(la.prior_id, m.event_id) AS event_id FROM m LEFT JOIN la ON la.own = m.event_id
    """,
)
def carried_event_ids(spark, sf):
    """Ids of an earlier projection carried over, one sequential decision per event."""
    c = cards(spark, sf)
    k = F.col("id").cast("long")
    previous = c.filter(k % 2 == 0).select("id", F.concat(F.lit("old"), _s(F.floor(k / 6))).alias("event_id"))
    out = events.place_cards(c, previous=previous)
    return out.select(F.col("id").alias("card_id"), "event_id")


@query(
    "event_aliases",
    """
    WITH p AS (SELECT doc_id, 'e' || (doc_id % 50) AS event_id, 'e' || (doc_id % 70) AS alias FROM documents)
    SELECT DISTINCT event_id, alias FROM p WHERE alias NOT IN (SELECT event_id FROM p)
    """,
)
def event_aliases(spark, sf):
    k = F.col("doc_id")
    d = documents(spark, sf)
    now = d.select(_s(k).alias("id"), F.concat(F.lit("e"), _s(k % 50)).alias("event_id"))
    before = d.select(_s(k).alias("id"), F.concat(F.lit("e"), _s(k % 70)).alias("event_id"))
    return events.event_aliases(now, before, None, None)


# --- overlay ---------------------------------------------------------------------------------
@query(
    "overlay_approved",
    """
    WITH c AS (SELECT doc_id, split_part(text, '.', 1) AS h FROM documents),
    m AS (SELECT doc_id, doc_id // 4 AS g, doc_id % 23 <> 0 AS ok FROM documents WHERE doc_id % 2 = 0)
    SELECT doc_id::varchar AS id, 'g' || g AS event_id FROM m WHERE g NOT IN (SELECT g FROM m WHERE NOT ok)
    """,
)
def overlay_approved(spark, sf):
    k = F.col("doc_id")
    d = documents(spark, sf)
    c = d.select(_s(k).alias("id"), F.col("title").alias("headline_en"), F.lit("h").alias("card_sha256"))
    m = d.filter(k % 2 == 0).select(
        _s(k).alias("id"), F.concat(F.lit("g"), _s(F.floor(k / 4))).alias("event_id"), F.when(k % 46 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("headline"),
        F.lit("h").alias("card_sha256"), F.lit("coverage").alias("role"),
    )
    return events.approved_members(c, m).select("id", "event_id")


@query(
    "date_corrections",
    "SELECT doc_id::varchar AS id, '2024-05-05' AS corrected FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 = 0 AND doc_id % 30 <> 0",
)
def date_corrections(spark, sf):
    k = F.col("doc_id")
    d = documents(spark, sf)
    c = d.select(_s(k).alias("id"), _s(F.col("day")).alias("published_at"), F.when(k % 10 == 0, "h").otherwise("x").alias("card_sha256"))
    fixes = d.filter(k % 5 == 0).select(
        _s(k).alias("card_id"), F.lit("published_at").alias("field"), F.when(k % 30 == 0, "1999-01-01").otherwise(_s(F.col("day"))).alias("original"),
        F.lit("2024-05-05").alias("corrected"), F.lit("h").alias("card_sha256"),
    )
    return events.valid_corrections(c, fixes)


@query(
    "backfill_applied",
    "SELECT doc_id::varchar AS id, doc_id % 3 = 0 AND doc_id % 6 = 0 AS updated, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE 'old' END AS summary FROM documents",
)
def backfill_applied(spark, sf):
    k = F.col("doc_id")
    d = documents(spark, sf)
    c = d.select(_s(k).alias("id"), F.when(k % 2 == 0, "h").otherwise("x").alias("card_sha256"), F.lit("a").alias("assessment"), F.lit("old").alias("summary"))
    side = d.filter(k % 3 == 0).select(_s(k).alias("card_id"), F.lit("h").alias("card_sha256"), F.lit("b").alias("assessment"), F.lit("new").alias("summary"))
    return events.apply_backfill(c, side).select("id", "updated", "summary")


@query(
    "relevance_scope",
    """
    SELECT 'e' || (doc_id // 5) AS event_id, 'exclude' AS scope FROM documents GROUP BY doc_id // 5
    HAVING (doc_id // 5) % 3 = 0 AND NOT bool_or(doc_id % 35 = 0) AND (doc_id // 5) % 2 = 0
    """,
)
def relevance_scope(spark, sf):
    """Bound to the complete membership: a changed hash or an extra card voids the review."""
    k = F.col("doc_id")
    g = F.floor(k / 5)
    d = documents(spark, sf)
    members = d.select(F.concat(F.lit("e"), _s(g)).alias("event_id"), _s(k).alias("card_id"), F.when(k % 35 == 0, "changed").otherwise("h").alias("card_sha256"))
    reviews = d.filter((g % 3 == 0) & ((g % 2 == 0) | (k % 5 != 4))).select(
        F.concat(F.lit("e"), _s(g)).alias("event_id"), F.lit("exclude").alias("scope"), _s(k).alias("card_id"), F.lit("h").alias("card_sha256")
    )
    return events.relevance_scope(members, reviews)


@query(
    "related_events",
    """
    WITH n AS (SELECT 'n' || n_nationkey AS name, 'e' || (n_nationkey % 12) AS event_id FROM nation),
    r AS (SELECT n_regionkey AS rid, 'n' || n_nationkey AS name FROM nation),
    l AS (SELECT DISTINCT rid, event_id FROM r JOIN n USING (name))
    SELECT DISTINCT a.event_id, b.event_id AS related_event_id FROM l a JOIN l b ON a.rid = b.rid AND a.event_id <> b.event_id
    """,
)
def related_events(spark, sf):
    n = table(spark, sf, "nation")
    name = F.concat(F.lit("n"), _s(F.col("n_nationkey")))
    names = n.select(name.alias("name"), F.concat(F.lit("e"), _s(F.col("n_nationkey") % 12)).alias("event_id"))
    relations = n.groupBy(F.col("n_regionkey").alias("relation_id")).agg(F.collect_set(name).alias("event_ids"))
    return events.related_events(names, relations)


@query(
    "archive_fingerprint",
    """
    SELECT count(*) AS rows, sha256(concat_ws('|', count(*)::varchar, l0::varchar, l1::varchar, l2::varchar, l3::varchar)) AS fingerprint FROM (
      SELECT sum(('0x' || substr(h, 1, 16))::hugeint) OVER () AS l0, sum(('0x' || substr(h, 17, 16))::hugeint) OVER () AS l1,
        sum(('0x' || substr(h, 33, 16))::hugeint) OVER () AS l2, sum(('0x' || substr(h, 49, 16))::hugeint) OVER () AS l3 FROM (SELECT sha256(text) AS h FROM documents))
    GROUP BY l0, l1, l2, l3
    """,
)
def archive_fingerprint(spark, sf):
    return events.archive_fingerprint(documents(spark, sf).select(F.sha2("text", 256).alias("card_sha256")))


@query(
    "display_tags",
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'parent' WHEN doc_id % 3 = 0 THEN 'z|parent' WHEN doc_id % 2 = 0 THEN 'child|parent' ELSE 'z' END AS tags FROM documents""",
)
def display_tags_query(spark, sf):
    k = F.col("doc_id")
    rule = [{"child": "child", "parent": "parent", "when": "Technology Income", "unless": "Technology Finance"}]
    d = documents(spark, sf)
    title = F.when(k % 3 == 0, "On technology income").otherwise("Other")
    tags = F.when(k % 2 == 0, F.array(F.lit("child"))).otherwise(F.array(F.lit("z")))
    return d.select("doc_id", F.array_join(display_tags(tags, title, rule), "|").alias("tags"))


# --- reader views ----------------------------------------------------------------------------
def _view_inputs(spark, sf):
    """Days whose index fits, days with a missing member, unmapped cards, an excluded event."""
    k = F.col("doc_id")
    d = documents(spark, sf)
    g = F.concat(F.lit("e"), _s(F.floor(k / 60) % 3), F.lit("-"), _s(k % 60))
    c = d.select(_s(k).alias("id"), F.col("day").alias("date"), F.array(F.col("lang")).alias("gps"), F.array(F.col("source")).alias("sectors"), k.alias("time"))
    mapped = d.filter(k % 7 != 0).select(g.alias("event_id"), _s(k).alias("card_id"), F.col("day").alias("date"))
    ghosts = d.filter(k % 60 == 11).select(g.alias("event_id"), F.concat(F.lit("ghost"), _s(k)).alias("card_id"), F.col("day").alias("date"))
    dm = mapped.unionByName(ghosts)
    e = mapped.groupBy("event_id").agg(F.min("card_id").alias("representative_card_id"), F.max("date").alias("date")).withColumns(
        {
            "reviewed_relevance": F.when(F.col("event_id").endswith("5"), "exclude"), "display_gps": F.array(F.lit("g")), "display_sectors": F.array(F.lit("s")),
            "priority_rank": F.length("event_id"), "material_t": F.lit(1).cast("long"),
        }
    )
    return c, e, dm


_VIEW_SQL = """
WITH c AS (SELECT doc_id, doc_id::varchar AS id, DATE '2024-01-01' + (doc_id % 60)::int AS date, 'e' || ((doc_id // 60) % 3) || '-' || (doc_id % 60) AS g, doc_id % 7 <> 0 AS mapped FROM documents),
bad AS (SELECT DISTINCT date FROM c WHERE doc_id % 60 = 11),
f AS (SELECT c.*, c.date NOT IN (SELECT date FROM bad) AS fits FROM c),
v AS (SELECT date, g AS entry_id, count(*) AS articles, TRUE AS grouped FROM f WHERE fits AND mapped AND g NOT LIKE '%5' GROUP BY ALL
      UNION ALL SELECT date, id, 1, FALSE FROM f WHERE NOT (fits AND mapped))
"""


@query("day_views", _VIEW_SQL + "SELECT date, entry_id, articles, grouped FROM v")
def day_views(spark, sf):
    c, e, dm = _view_inputs(spark, sf)
    return views.day_view(c, e, e.drop("reviewed_relevance"), dm).select("date", "entry_id", "articles", "grouped")


@query("day_counts", _VIEW_SQL + "SELECT date, count(*) AS entries, sum(articles)::bigint AS articles FROM v GROUP BY date")
def day_counts(spark, sf):
    c, e, dm = _view_inputs(spark, sf)
    return views.date_event_counts(views.day_view(c, e, e.drop("reviewed_relevance"), dm))


@query("index_fit", _VIEW_SQL + "SELECT date, bool_and(fits) AS fits FROM f GROUP BY date")
def index_fit(spark, sf):
    c, _, dm = _view_inputs(spark, sf)
    return views.fitting_days(c, dm)


@query(
    "all_view",
    _VIEW_SQL + "SELECT g AS entry_id, count(*) AS articles, TRUE AS grouped FROM c WHERE mapped AND g NOT LIKE '%5' GROUP BY g UNION ALL SELECT id, 1, FALSE FROM c WHERE NOT mapped",
)
def all_view(spark, sf):
    c, e, dm = _view_inputs(spark, sf)
    return views.all_view(c, e, dm).select("entry_id", "articles", "grouped")


@query(
    "index_errors",
    """
    SELECT 'card in two events' AS fault, doc_id::varchar AS id FROM documents WHERE doc_id % 40 = 0
    UNION ALL SELECT 'representative outside event', 'e' || (doc_id // 10) FROM documents WHERE doc_id % 100 = 50
    UNION ALL SELECT 'day member outside event', doc_id::varchar FROM documents WHERE doc_id % 90 = 1
    """,
)
def index_errors(spark, sf):
    k = F.col("doc_id")
    d = documents(spark, sf)
    ev = F.concat(F.lit("e"), _s(F.floor(k / 10)))
    m = d.select(ev.alias("event_id"), _s(k).alias("card_id"))
    doubled = m.unionByName(d.filter(k % 40 == 0).select(F.lit("other").alias("event_id"), _s(k).alias("card_id")))
    e = d.filter(k % 10 == 0).select(ev.alias("event_id"), F.when(k % 100 == 50, "nobody").otherwise(_s(k)).alias("representative_card_id"))
    day = d.select(F.when(k % 90 == 1, "elsewhere").otherwise(ev).alias("event_id"), _s(k).alias("card_id"))
    return views.index_errors(e, doubled, day)


@query(
    "sorted_entries",
    "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 5 <> 0 THEN doc_id % 17 END ASC NULLS LAST, doc_id % 60 DESC, doc_id) AS place FROM documents WHERE lang IN ('en', 'fr') AND source = 'src3'",
)
def sorted_entries(spark, sf):
    """Reader's filter and priority order, shown as places."""
    k = F.col("doc_id")
    d = documents(spark, sf).select(
        k, F.array("lang").alias("gps"), F.array("source").alias("sectors"), F.when(k % 5 != 0, k % 17).alias("rank"), (k % 60).alias("time"), k.alias("ord"), "lang"
    )
    kept = views.tag_filter(d, None, "src3").filter(F.col("lang").isin("en", "fr"))
    placed_rows = cut(views.sort_entries(kept), "sorted")
    from newsloom.operators.skew import rank_all

    order = [F.col("rank").asc_nulls_last(), F.col("time").desc_nulls_last(), F.col("ord").asc()]
    return rank_all(placed_rows, order, [], "place").select("doc_id", "place")


@query(
    "visible_events",
    "SELECT doc_id FROM documents WHERE doc_id % 4 <> 2",
)
def visible_events(spark, sf):
    k = F.col("doc_id")
    d = documents(spark, sf).withColumn("reviewed_relevance", F.when(k % 4 == 2, "exclude").when(k % 4 == 1, "include"))
    return views.visible(d).select("doc_id")


@query(
    "tag_labels",
    "SELECT doc_id, lang AS tag, CASE lang WHEN 'en' THEN '英语' WHEN 'fr' THEN 'French' ELSE lang END AS label FROM documents",
)
def tag_labels(spark, sf):
    labels = spark.createDataFrame([("en", "English", "英语"), ("fr", "French", "")], "tag string, en string, zh string")
    d = documents(spark, sf).withColumn("gps", F.array("lang"))
    return views.tag_labels(d, labels, "doc_id", "gps", "zh")


@query("day_index", "SELECT o_orderdate::date AS date, count(*) AS cards FROM orders GROUP BY 1")
def day_index(spark, sf):
    return views.day_index(table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate")))


@query(
    "known_versions",
    """SELECT substr(sha256('https://site.example/' || (doc_id // 3) || '?utm_x=1'), 1, 12) AS entry_id, sha256(text) AS fingerprint, lpad(doc_id::varchar, 9, '0') AS card_id
    FROM documents WHERE doc_id % 8 = 1""",
)
def known_versions(spark, sf):
    return entries.known_versions(cards(spark, sf)).select("entry_id", "fingerprint", "card_id")


@query("stamp_days", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '2024-05-05T00:00:00+08:00' ELSE '2024-05-05T10:00:00+00:00' END AS stamp FROM documents")
def stamp_days(spark, sf):
    fix = F.when(F.col("doc_id") % 2 == 0, "2024-05-05").otherwise("2024-05-05T10:00:00+00:00")
    return documents(spark, sf).select("doc_id", times.corrected_stamp(fix).alias("stamp"))

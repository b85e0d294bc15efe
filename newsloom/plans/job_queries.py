"""Whole jobs over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import ids
from newsloom.operators import entries
from newsloom.plans import research
from newsloom.plans.bindings import RULES, documents
from newsloom.plans.event_queries import cards
from newsloom.plans.grouping_queries import _GATES_SQL
from newsloom.plans.refresh import candidates
from newsloom.plans.registry import query
from newsloom.plans.text_queries import _PROPOSE_SQL, _RULE_SQL, _SECTORS, _base_articles
from newsloom.streaming import refresh
from newsloom.streaming.state import arrivals, job_folder


def _s(c):
    return c.cast("string")


_RUN_SQL = f"""
WITH pr AS ({_PROPOSE_SQL}), h AS (SELECT doc_id AS article_id, sha256(text) AS h FROM documents),
q AS (SELECT pr.*, lpad(h.article_id::varchar, 9, '0') AS aid, min(lpad(h.article_id::varchar, 9, '0')) OVER (PARTITION BY h) AS root, count(*) OVER (PARTITION BY h) AS size,
  row_number() OVER (PARTITION BY h ORDER BY credibility DESC, h.article_id) AS rn FROM pr JOIN h USING (article_id)),
s AS (SELECT *, fit, materiality AS mat, transmission AS tra, CASE materiality WHEN 20 THEN 8 WHEN 15 THEN 6 ELSE 3 END AS act, credibility AS cre, novelty AS nov, FALSE AS review, relevance_level AS lvl,
  FALSE AS crit FROM q WHERE rn = 1), {_GATES_SQL.replace("CASE WHEN g_novelty = 'fail' THEN 'no_new_fact' END]", "CASE WHEN g_novelty = 'fail' THEN 'no_new_fact' END, CASE WHEN lvl IS NULL THEN 'ambiguous_identity' END]")}
"""


@query(
    "research_run",
    _RUN_SQL + """SELECT aid AS primary_article_id, size, total AS total_score, recommendation,
    array_to_string(list_sort(CASE WHEN size > 1 THEN list_append(reason_codes, 'duplicate') ELSE reason_codes END), '|') AS codes, row_number() OVER (ORDER BY total DESC,
      'pe-' || substr(sha256((SELECT concat_ws('|', count(*)::varchar, sum(('0x' || substr(sha256(q.aid), 1, 16))::hugeint)::varchar, sum(('0x' || substr(sha256(q.aid), 17, 16))::hugeint)::varchar, sum(('0x' || substr(sha256(q.aid), 33, 16))::hugeint)::varchar, sum(('0x' || substr(sha256(q.aid), 49, 16))::hugeint)::varchar) FROM q WHERE q.root = g.root)), 1, 12)) AS position FROM g""",
)
def research_run(spark, sf):
    """Propose, cluster, score, validate, rank; no region is ever European here, so no tie-break moves."""
    a = _base_articles(spark, sf).withColumn("article_id", F.lpad(_s(F.col("article_id")), 9, "0"))
    e = documents(spark, sf).select(
        F.lpad(_s(F.col("doc_id")), 9, "0").alias("article_id"), F.lit(None).cast("string").alias("canonical_url"), F.sha2("text", 256).alias("evidence_hash"),
        F.lit(None).cast("string").alias("supersedes_article_id"),
    )
    out = research.run(a, e, _SECTORS, "run-1")["decisions"]
    return out.select("primary_article_id", "size", "total_score", "recommendation", F.array_join("disposition_reason_codes", "|").alias("codes"), "position")


def _feed_entries(spark, sf):
    k = F.col("doc_id")
    return documents(spark, sf).select(
        k, F.lit("").alias("title"), F.col("text").alias("description"), F.concat(F.lit("https://feed.example/"), _s(k)).alias("url"), F.col("source").alias("publisher"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=(k % 10).cast("int"))).alias("published"), F.lit("trade").alias("feed"),
        F.when(k % 6 == 0, "regulator").when(k % 6 == 1, "issuer_filing").alias("origin"), F.array(F.lit("own")).alias("feed_tags"), F.lit(None).cast("string").alias("discovery"),
    )


@query(
    "refresh_candidates",
    f"""SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'primary filing' WHEN doc_id % 6 = 0 AND reason = 'no material event' THEN 'regulator release' ELSE reason END AS reason
    FROM ({_RULE_SQL}) WHERE (keep OR doc_id % 6 = 1 OR (doc_id % 6 = 0 AND reason = 'no material event')) AND doc_id % 10 >= 6 AND doc_id % 8 <> 3""",
)
def refresh_candidates(spark, sf):
    """A refresh at 2024-01-10: fresh, not rejected within 14 days, matched by the rule."""
    e = _feed_entries(spark, sf)
    rejected = e.filter(F.col("doc_id") % 8 == 3).select(ids.card_id(F.col("url")).alias("entry_id"), F.lit("2024-01-05").cast("date").alias("day"))
    out = candidates(e, RULES, cards(spark, sf), rejected, F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    return out.select("doc_id", "reason")


@query(
    "made_cards",
    r"""SELECT substr(sha256('https://feed.example/' || doc_id), 1, 12) AS id, (TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 10) + INTERVAL 8 HOUR)::date AS date,
      CASE WHEN doc_id % 3 = 0 THEN 'It closed.' ELSE 'It closed. Fine.' END AS summary, doc_id % 2 = 0 AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 8 AS assessable FROM documents""",
)
def made_cards(spark, sf):
    """Item and brief to card: filler dropped, a quoted assessment accepted only when it is verbatim."""
    k = F.col("doc_id")
    items = entries.to_item(_feed_entries(spark, sf).withColumn("form", F.lit("8-K")).withColumn("domains", F.array(F.lit("feed.example"))))
    quote = F.when(k % 2 == 0, F.left(F.regexp_replace("text", r"(?U)^\s+", ""), F.lit(12))).otherwise("never in the text")
    raw = F.to_json(
        F.struct(
            F.lit("bounded").alias("severity"), F.lit("sector").alias("linkage"), F.lit(False).alias("current_adverse"), F.lit(False).alias("resolved"),
            F.create_map(F.lit("severity"), quote, F.lit("linkage"), quote).alias("quotes"), F.lit("why").alias("reason_en"), F.lit("原因").alias("reason_zh"),
        )
    )
    summary = F.when(k % 3 == 0, "It closed. No further details were given.").otherwise("It closed. Fine.")
    briefed = items.withColumns(
        {
            "assessment_raw": raw, "headline": F.struct(F.lit("h").alias("en"), F.lit("标").alias("zh")), "summary": F.struct(summary.alias("en"), F.lit("摘要。").alias("zh")),
            "gps": F.array(F.lit("alpha")), "sectors": F.array().cast("array<string>"), "region": F.lit("US"), "relevance_reason": F.lit("r"),
        }
    )
    out = entries.make_cards(briefed)
    return out.select("id", "date", F.col("summary.en").alias("summary"), F.col("assessment.assessable").alias("assessable"))


#: Landings of the days 3, 6, 9 and 12; each fetches again what was published since the fourth day before.
_LANDINGS = (3, 6, 9, 12)
_LANDED_SQL = f"""
WITH d AS (SELECT r.*, 1 + doc_id % 10 AS day, length(d.text) AS size, doc_id % 6 AS o FROM ({_RULE_SQL}) r JOIN documents d USING (doc_id)),
m AS (SELECT doc_id, day, size, CASE WHEN o = 1 THEN 'filing' WHEN o = 0 AND reason = 'no material event' THEN 'release' ELSE reason END AS why, keep OR o = 1 OR (o = 0 AND reason = 'no material event') AS keep FROM d),
l AS (SELECT doc_id, day, size, b, landed FROM m, (SELECT unnest([0, 1, 2, 3]) AS b, unnest([3, 6, 9, 12]) AS landed) WHERE keep AND day BETWEEN landed - 3 AND landed),
f AS (SELECT *, CASE WHEN size % 7 = 0 THEN 'only edited' WHEN size % 5 = 0 THEN 'irrelevant' WHEN size % 11 = 0 THEN 'invalid' ELSE 'published' END AS outcome, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS nth FROM l)
"""


@query(
    "refresh_stream",
    _LANDED_SQL
    + """SELECT substr(sha256('https://feed.example/' || doc_id), 1, 12) AS entry_id, outcome, b AS batch FROM f
    WHERE (nth = 1 OR outcome = 'invalid') AND (outcome <> 'published' OR day >= 12 - 8)""",
)
def refresh_stream(spark, sf):
    """Four landings through the refresh stream, the third of them run twice: what became of every entry, and when.

    What is said about an item follows from its text; days older than eight days at the last landing have expired.
    """

    def brief(items):
        size = F.length("text")
        return items.withColumns(
            {
                "relevant": size % 5 != 0, "headline": F.struct(F.col("publisher").alias("en"), F.lit("标题").alias("zh")),
                "summary": F.struct(F.when(size % 11 == 0, "").otherwise(F.col("text")).alias("en"), F.lit("摘要").alias("zh")), "gps": F.array(F.lit("alpha")),
                "sectors": F.array().cast("array<string>"), "region": F.lit("US"), "relevance_reason": F.lit("named"), "published_basis": F.when(size % 7 == 0, "sitemap_lastmod"),
                "source_published_at": F.when(size % 7 == 0, "2023-12-01"),
            }
        )

    e = _feed_entries(spark, sf).drop("doc_id").withColumn("form", F.lit("8-K")).withColumn("domains", F.array(F.lit("feed.example")))
    landing = F.explode(F.array(*[F.struct(F.lit(n).alias("arrival"), F.lit(day).alias("day")) for n, day in enumerate(_LANDINGS)]))
    landed = e.select("*", landing.alias("l")).withColumn("landed_at", F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(days=F.col("l.day") - 1))
    landed = landed.filter((F.col("published") <= F.col("landed_at")) & (F.col("published") > F.col("landed_at") - F.expr("INTERVAL 4 DAY")))
    folder, job = job_folder(spark, "refresh"), []
    arrivals(landed.withColumn("arrival", F.col("l.arrival")).drop("l"), F.col("arrival"), len(_LANDINGS), f"{folder}/in", lambda s: job.append(refresh.refresh_stream(s, folder, RULES, brief, 8)))
    done = job[-1]
    done.on_batch(landed.filter("l.arrival = 2").drop("l"), 2)
    with_batch = lambda t: spark.read.parquet(t.path)
    published = with_batch(done.cards).select(F.col("id").alias("entry_id"), F.lit("published").alias("outcome"), "batch")
    turned = with_batch(done.rejected).select("entry_id", F.col("reason").alias("outcome"), "batch")
    faulty = with_batch(done.invalid).select(F.col("id").alias("entry_id"), F.lit("invalid").alias("outcome"), "batch")
    return published.unionByName(turned).unionByName(faulty).withColumn("batch", F.col("batch").cast("int"))

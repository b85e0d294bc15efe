"""Streams over the supplied files, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.plans.registry import query, table
from newsloom.streaming import jobs
from newsloom.streaming.state import arrivals, file_stream, job_folder, run_to_end

_NOW = "2024-01-20 12:00:00"


def _s(c):
    return c.cast("string")


def _entries(spark, sf):
    e = file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    return e.select(
        "event_id", F.concat("event_type", F.lit("/"), _s(F.col("user_id"))).alias("entry_id"), F.col("props").alias("fingerprint"),
        F.col("ts").cast("timestamp").alias("published"), "event_type", "user_id",
    )


@query(
    "stream_dedupe",
    f"SELECT DISTINCT event_type || '/' || user_id AS entry_id, props AS fingerprint FROM events WHERE ts BETWEEN TIMESTAMP '{_NOW}' - INTERVAL 3 DAY AND TIMESTAMP '{_NOW}' + INTERVAL 1 HOUR",
)
def stream_dedupe(spark, sf):
    kept = jobs.distinct_version_stream(_entries(spark, sf), F.to_timestamp(F.lit(_NOW)))
    return spark.read.parquet(run_to_end(kept, job_folder(spark, "dedupe"))).select("entry_id", "fingerprint")


#: Four arrivals by time; every 29th event comes one arrival late.
_ARRIVAL_SQL = "least(3, date_diff('day', DATE '2024-01-01', ts::date) // 8 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END)"
_WEEK = 8


def _arriving(spark, sf, columns, job):
    """The events in four arrivals through a job, a run each; the rows of all runs."""
    e = table(spark, sf, "events").withColumn("published", F.col("ts").cast("timestamp")).withColumn("id", F.col("event_id"))
    late = F.when(F.col("event_id") % 29 == 0, 1).otherwise(0)
    arrival = F.least(F.lit(3), F.floor(F.datediff(F.to_date("published"), F.lit("2024-01-01")) / _WEEK) + late)
    folder, out = job_folder(spark, "arrivals"), []
    arrivals(e.select(*columns, "published", arrival.alias("arrival")), F.col("arrival"), 4, f"{folder}/in", lambda s: out.append(job(s, folder)))
    return out[-1]


@query(
    "stream_versions",
    f"""
    WITH e AS (SELECT event_type || '/' || user_id AS entry_id, props AS fingerprint, event_id, ts, {_ARRIVAL_SQL} AS b FROM events),
    f AS (SELECT entry_id, fingerprint, b, arg_max(event_id, (ts, -event_id)) AS id, max(ts) AS ts FROM e GROUP BY ALL),
    v AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY entry_id, fingerprint ORDER BY b) = 1)
    SELECT id, fingerprint, (SELECT arg_max(o.id, (o.ts, o.id)) FROM v o WHERE o.entry_id = v.entry_id AND o.b < v.b) AS revision_of FROM v
    """,
)
def stream_versions(spark, sf):
    """Unseen versions over four arrivals, each with the newest version known before its arrival."""
    columns = ["id", F.concat("event_type", F.lit("/"), _s(F.col("user_id"))).alias("entry_id"), F.col("props").alias("fingerprint")]
    return _arriving(spark, sf, columns, lambda s, folder: jobs.new_versions_job(s, folder, delay_days=2 * _WEEK)).select("id", "fingerprint", "revision_of")


@query(
    "rejected_ttl",
    f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id, ts::date AS day, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY {_ARRIVAL_SQL}, ts, event_id) AS n FROM events),
    r AS (SELECT user_id, 0 AS n, NULL::BIGINT AS event_id, NULL::DATE AS memory, FALSE AS passed FROM e GROUP BY user_id
      UNION ALL
      SELECT e.user_id, e.n, e.event_id, CASE WHEN held OR NOT bad THEN memory ELSE day END, NOT held AND NOT bad FROM (
        SELECT e.*, r.memory, coalesce(r.memory >= e.day - 5, FALSE) AS held FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) e)
    SELECT event_id AS id FROM r WHERE passed
    """,
)
def rejected_ttl(spark, sf):
    """Entries whose user was not turned down in the five days before, over four arrivals."""
    columns = ["id", F.col("user_id").alias("key"), (F.col("event_type") == "error").alias("rejected")]
    return _arriving(spark, sf, columns, lambda s, folder: jobs.rejection_memory_job(s, folder, days=5, delay_days=2 * _WEEK))


@query(
    "stream_anchor",
    f"""
    WITH RECURSIVE e AS (SELECT event_id AS id, event_type || (user_id % 8) AS head, ts, {_ARRIVAL_SQL} AS b FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY b, ts, id) AS n FROM e),
    r AS (SELECT head, 0 AS n, NULL::BIGINT AS id, NULL::BIGINT AS story, []::STRUCT(t TIMESTAMP, id BIGINT, b BIGINT)[] AS anchors FROM o GROUP BY head
      UNION ALL
      SELECT head, n, id, coalesce(old, own, id), CASE WHEN old IS NULL AND own IS NULL THEN list_append(anchors, {{'t': ts, 'id': id, 'b': b}}) ELSE anchors END FROM (
        SELECT o.*, r.anchors,
          list_sort(list_filter(r.anchors, lambda a: a.b < o.b AND a.t BETWEEN o.ts - INTERVAL 7 DAY AND o.ts + INTERVAL 7 DAY))[1].id AS old,
          list_filter(r.anchors, lambda a: a.b = o.b AND a.t BETWEEN o.ts - INTERVAL 7 DAY AND o.ts)[1].id AS own
        FROM r JOIN o ON o.head = r.head AND o.n = r.n + 1))
    SELECT id, story FROM r WHERE n > 0
    """,
)
def stream_anchor(spark, sf):
    """Stories of seven days over four arrivals; late cards join an anchor on either side."""
    columns = ["id", F.concat("event_type", _s(F.col("user_id") % 8)).alias("head")]
    return _arriving(spark, sf, columns, lambda s, folder: jobs.story_job(s, folder, delay_days=2 * _WEEK))


_ARTICLE_SQL = "SELECT lang || '/' || source AS article_id, doc_id AS seq, CASE WHEN trim(text) <> '' THEN sha256((length(text) - length(replace(text, chr(10), '')))::varchar) END AS digest"


@query(
    "stream_revisions",
    f"""
    WITH d AS ({_ARTICLE_SQL}, doc_id % 3 AS b FROM documents),
    v AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY b, seq) AS n FROM d),
    p AS (SELECT *, (SELECT arg_max(o.digest, o.n) FROM v o WHERE o.article_id = v.article_id AND o.n < v.n AND o.digest IS NOT NULL) AS previous FROM v)
    SELECT article_id, seq, CASE WHEN digest IS NULL THEN 'invalid' WHEN previous IS NULL THEN 'new' WHEN previous = digest THEN 'duplicate' ELSE 'changed' END AS outcome, previous FROM p
    """,
)
def stream_revisions(spark, sf):
    """Every document as the next state of its source's page in its language; the digest is that of the number of lines."""
    lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    d = table(spark, sf, "documents").select(
        F.concat("lang", F.lit("/"), "source").alias("article_id"), F.col("doc_id").alias("seq"), F.when(F.trim("text") != "", F.sha2(_s(lines), 256)).alias("digest"), (F.col("doc_id") % 3).alias("arrival")
    )
    folder, out = job_folder(spark, "revisions"), []
    arrivals(d, F.col("arrival"), 3, f"{folder}/in", lambda s: out.append(jobs.revision_job(s, folder)))
    return out[-1].select("article_id", "seq", "outcome", "previous")


@query(
    "stream_ledger",
    "SELECT conv_id::varchar AS event_id, (turn % 2)::varchar AS revision, arg_max(CASE WHEN role = 'user' THEN 'rejected' ELSE 'approved' END, turn) AS status FROM conversations GROUP BY ALL",
)
def stream_ledger(spark, sf):
    c = table(spark, sf, "conversations").select(
        _s(F.col("conv_id")).alias("event_id"), (F.col("turn") % 2).alias("revision"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "rejected").otherwise("approved").alias("status")
    )
    folder, out = job_folder(spark, "ledger"), []
    arrivals(c, F.when(F.col("seq") < 3, 0).otherwise(1), 2, f"{folder}/in", lambda s: out.append(jobs.review_job(spark, s, folder)))
    return out[-1].select("event_id", "revision", "status")

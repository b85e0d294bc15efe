"""Rules, ids, URLs, evidence scope, amounts and text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import ids, identity, money, text, times
from newsloom.operators import baseline, corpus, rules
from newsloom.operators.entity_index import with_entities
from newsloom.operators.skew import rank_all
from newsloom.plans.bindings import RULES, documents, word_sql
from newsloom.plans.registry import query, table

# --- keyword rules ---------------------------------------------------------------------------
_CTX = word_sql(RULES.context)


def _tags_sql(tags):
    parts = []
    for key, tag in tags.items():
        test = word_sql(tag.terms) + (f" AND {_CTX}" if tag.needs_context else "")
        parts.append(f"CASE WHEN {test} THEN '{key}' END")
    return f"concat_ws('|', {', '.join(parts)})"


_EXCLUDED = "CASE " + " ".join(f"WHEN {word_sql([t])} THEN 'excluded: {t}'" for t in RULES.exclude) + " END"
_RULE_SQL = f"""
SELECT doc_id, gps, sectors, reason, reason = 'matched' AS keep FROM (
  SELECT doc_id, gps, sectors,
    coalesce({_EXCLUDED},
      CASE WHEN gps = '' AND sectors = '' THEN 'no tracked manager or sub-sector'
           WHEN NOT {word_sql(RULES.event)} THEN 'no material event' ELSE 'matched' END) AS reason
  FROM (SELECT doc_id, text, {_tags_sql(RULES.gps)} AS gps, {_tags_sql(RULES.sectors)} AS sectors FROM documents))
"""


def _ruled(spark, sf):
    out = rules.rule_match(documents(spark, sf).select("doc_id", "source", "day", "text"), RULES)
    return out.withColumns({c: F.array_join(c, "|") for c in ("gps", "sectors")})


@query("keyword_rule", _RULE_SQL)
def keyword_rule(spark, sf):
    return _ruled(spark, sf).select("doc_id", "gps", "sectors", "reason", "keep")


@query("rule_reasons", f"SELECT reason, count(*) AS n FROM ({_RULE_SQL}) GROUP BY reason")
def rule_reasons(spark, sf):
    return _ruled(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "rule_origins",
    f"""
    SELECT doc_id, CASE WHEN o = 0 THEN 'own' ELSE gps END AS gps, CASE WHEN o = 0 THEN '' ELSE sectors END AS sectors,
      CASE WHEN o = 0 THEN 'primary filing' WHEN o = 1 AND reason = 'no material event' THEN 'regulator release'
           ELSE reason END AS reason,
      o = 0 OR (o = 1 AND reason = 'no material event') OR keep AS keep
    FROM (SELECT *, doc_id % 4 AS o FROM ({_RULE_SQL}))
    """,
)
def rule_origins(spark, sf):
    d = documents(spark, sf).withColumn(
        "origin", F.when(F.col("doc_id") % 4 == 0, "issuer_filing").when(F.col("doc_id") % 4 == 1, "regulator")
    )
    d = d.withColumn("own_tags", F.array(F.lit("own")))
    out = rules.apply_origin(rules.rule_match(d, RULES), tags="own_tags")
    return out.select("doc_id", F.array_join("gps", "|").alias("gps"), F.array_join("sectors", "|").alias("sectors"), "reason", "keep")


_TERM_SQL = r"""
WITH terms AS (
  SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:2], ' ') AS term FROM benchmark),
docs AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents)
SELECT doc_id, term FROM docs, terms WHERE contains(t, ' ' || term || ' ')
"""


@query("term_dictionary", _TERM_SQL)
def term_dictionary(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1)
    terms = table(spark, sf, "benchmark").select(F.array_join(F.slice(words, 1, 2), " ").alias("term")).distinct()
    return rules.match_terms_by_join(documents(spark, sf), terms, "doc_id", "text").select("doc_id", "term").distinct()


# --- ids and URLs ----------------------------------------------------------------------------
@query(
    "card_ids",
    "SELECT page_id, substr(sha256(lower(regexp_replace(split_part(trim(url), '#', 1), '/+$', ''))), 1, 12) AS card_id FROM pages",
)
def card_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.card_id(F.col("url")).alias("card_id"))


@query(
    "article_uuid5",
    """
    SELECT page_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
      translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)||'-'||substr(h,21,12) AS article_id
    FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
    """,
)
def article_uuid5(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.uuid5_url(F.col("url")).alias("article_id"))


_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"


@query(
    "host_filter",
    f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} = 'example.net' OR {_HOST} LIKE '%.example.net' "
    f"OR {_HOST} = 'spam-farm.example.org' OR {_HOST} LIKE '%.spam-farm.example.org'",
)
def host_filter(spark, sf):
    p = table(spark, sf, "pages")
    return p.filter(ids.host_in(F.col("url"), ["example.net", "spam-farm.example.org"])).select(
        "page_id", ids.host(F.col("url")).alias("host")
    )


_QUERY = "CASE WHEN contains(bare, '?') THEN list_filter(string_split(regexp_replace(bare, '^[^?]*[?]', ''), '&'), lambda p: p <> '' AND NOT ({})) ELSE [] END"


def _url_sql(drop, fragment, lower):
    kept = _QUERY.format(drop)
    tail = f"array_to_string(list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    base = "split_part(bare, '?', 1)"
    if lower:
        head = f"regexp_extract({base}, '^[a-zA-Z]+://[^/]*')"
        base = f"lower({head}) || substr({base}, length({head}) + 1)"
    frag = "CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END" if fragment else "''"
    return f"{base} || CASE WHEN {tail} = '' THEN '' ELSE '?' || {tail} END || {frag}"


_LISTED = ", ".join(f"'{p}'" for p in fv.TRACKING_PARAMETERS)


@query(
    "canonical_urls",
    f"""
    SELECT page_id,
      {_url_sql("starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid')", False, True)} AS event_url,
      {_url_sql(f"lower(split_part(p, '=', 1)) IN ({_LISTED})", True, False)} AS evidence_url
    FROM (SELECT page_id, url, split_part(url, '#', 1) AS bare FROM pages)
    """,
)
def canonical_urls(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", ids.event_url(F.col("url")).alias("event_url"), ids.evidence_url(F.col("url")).alias("evidence_url"))


@query(
    "canonical_urls_native",
    f"""
    SELECT page_id, {_url_sql("starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid')", False, True)} AS event_url
    FROM (SELECT page_id, url, split_part(url, '#', 1) AS bare FROM pages)
    """,
)
def canonical_urls_native(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.event_url_native(F.col("url")).alias("event_url"))


@query(
    "fingerprints",
    r"""
    SELECT doc_id, sha256('[' || to_json(title)::varchar || ', ' || to_json(body)::varchar || ']') AS fingerprint FROM (
      SELECT doc_id, trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g')) AS title,
             trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents)
    """,
)
def fingerprints(spark, sf):
    return documents(spark, sf).select("doc_id", ids.source_fingerprint(F.col("title"), F.col("text")).alias("fingerprint"))


# --- evidence --------------------------------------------------------------------------------
_BODY = r"regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[ \t]+\n', '\n', 'g'), '\n{3,}', '\n\n', 'g')".replace(
    r"'\n'", "chr(10)"
).replace(r"'\n\n'", "chr(10) || chr(10)")
_SCOPE_SQL = f"""
SELECT doc_id, access_status, CASE
    WHEN access_status = 'unavailable' THEN 'metadata_only'
    WHEN gate THEN CASE WHEN n >= 150 THEN 'primary_excerpt' ELSE 'metadata_only' END
    WHEN n < 150 THEN 'metadata_only' WHEN n < 400 THEN 'primary_excerpt'
    WHEN doc_id % 2 = 1 THEN 'primary_excerpt' ELSE 'full_text' END AS evidence_scope
FROM (SELECT doc_id, n, gate, CASE WHEN doc_id % 17 = 0 OR n = 0 THEN 'unavailable'
             WHEN gate OR n < 400 THEN 'partial' ELSE 'accessible' END AS access_status
      FROM (SELECT doc_id, length({_BODY}) AS n,
              CASE WHEN doc_id % 5 = 0 THEN doc_id % 10 = 0 ELSE contains(lower(text), 'members only') END AS gate
            FROM documents))
"""


def _captures(spark, sf):
    k = F.col("doc_id")
    return documents(spark, sf).select(
        k.alias("article_id"),
        "text",
        F.when(k % 2 == 1, "excerpt").otherwise("full").alias("mode"),
        F.when(k % 5 == 0, k % 10 == 0).alias("gated"),
        F.when(k % 17 == 0, "unavailable").alias("access_status"),
    )


def _scoped(spark, sf):
    c = _captures(spark, sf)
    s = corpus.capture_scope(F.col("text"), F.col("access_status"), F.col("mode"), F.col("gated"))
    return c.select(F.col("article_id").alias("doc_id"), s.alias("s")).select("doc_id", "s.*")


@query("evidence_scope", _SCOPE_SQL)
def evidence_scope(spark, sf):
    return _scoped(spark, sf)


@query("capture_report", f"SELECT access_status, evidence_scope, count(*) AS records FROM ({_SCOPE_SQL}) GROUP BY ALL")
def capture_report(spark, sf):
    return corpus.capture_report(_scoped(spark, sf))


@query("evidence_digests", f"SELECT doc_id, 'sha256:' || sha256({_BODY}) AS digest FROM documents")
def evidence_digests(spark, sf):
    return documents(spark, sf).select("doc_id", ids.evidence_digest(F.col("text")).alias("digest"))


@query(
    "boilerplate",
    f"""
    SELECT doc_id, CASE WHEN n >= 3 THEN 'unavailable' END AS access_status, CASE WHEN n >= 3 THEN 0 ELSE length(text) END AS chars,
      CASE WHEN n >= 3 THEN 'boilerplate: identical text returned for ' || n || ' different articles, so the page body was not captured' END AS capture_failure
    FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY {_BODY}) AS n FROM documents)
    """,
)
def boilerplate(spark, sf):
    c = documents(spark, sf).select("doc_id", "text", F.lit(None).cast("string").alias("access_status"))
    return corpus.flag_boilerplate(c).select("doc_id", "access_status", F.length("text").cast("long").alias("chars"), "capture_failure")


_FILLER = (
    "CASE doc_id % 4 WHEN 0 THEN ' No further details were given. More ' WHEN 1 THEN ' The terms were not disclosed! \"Yes.\" Then ' "
    "ELSE ' It closed. ' END"
)
_STRIP_RE = fv.SUMMARY_ABSENCE_EN.replace("'", "''")
_FILLED = f"split_part(text, '.', 1) || '.' || {_FILLER} || text"


@query(
    "strip_claims",
    rf"""
    SELECT doc_id, CASE WHEN kept = '' THEN trim(t) ELSE kept END AS summary FROM (
      SELECT doc_id, t, trim(array_to_string(list_filter(string_split(regexp_replace(t, '([.!?]["''”’)]?)\s+', '\1' || chr(1), 'g'), chr(1)),
        lambda s: trim(s) <> '' AND NOT regexp_matches(s, '{_STRIP_RE}')), ' ')) AS kept
      FROM (SELECT doc_id, regexp_replace({_FILLED}, '\s+', ' ', 'g') AS t FROM documents))
    """,
)
def strip_claims(spark, sf):
    k = F.col("doc_id")
    filler = (
        F.when(k % 4 == 0, " No further details were given. More ")
        .when(k % 4 == 1, ' The terms were not disclosed! "Yes." Then ')
        .otherwise(" It closed. ")
    )
    t = F.regexp_replace(F.concat("title", F.lit("."), filler, F.col("text")), r"\s+", " ")
    return documents(spark, sf).select("doc_id", text.strip_absence(t).alias("summary"))


# --- headlines and tokens --------------------------------------------------------------------
def _norm_sql(expr):
    return rf"trim(regexp_replace(replace(lower({expr}), 'ß', 'ss'), '\s+', ' ', 'g'))"


_HEADLINE = "split_part(text, '.', 1) || CASE doc_id % 3 WHEN 0 THEN ' Q1' WHEN 1 THEN ' in March' ELSE '' END"


@query(
    "headline_keys",
    rf"""
    SELECT doc_id, CASE WHEN regexp_matches(h, '(?i)\d|\b(?:first|second|third|fourth) quarter\b|\bq[1-4]\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b')
      THEN {_norm_sql('h')} END AS head
    FROM (SELECT doc_id, {_HEADLINE} AS h FROM documents)
    """,
)
def headline_keys(spark, sf):
    k = F.col("doc_id")
    h = F.concat("title", F.when(k % 3 == 0, " Q1").when(k % 3 == 1, " in March").otherwise(""))
    return documents(spark, sf).select("doc_id", identity.headline_key(h).alias("head"))


@query(
    "title_keys",
    f"SELECT doc_id, {_norm_sql('split_part(text, chr(46), 1)')} AS key FROM documents",
)
def title_keys(spark, sf):
    t = F.concat("title", F.lit(" - "), F.col("source"))
    return documents(spark, sf).select("doc_id", text.title_key(t).alias("key"))


_STOP_H = ", ".join(f"'{w}'" for w in fv.HEADLINE_STOPWORDS)
_STOP_S = ", ".join(f"'{w}'" for w in fv.SEARCH_STOPWORDS)
SEARCH_WORDS_SQL = (
    "list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z][a-z''.-]+'), "
    f"lambda w: w NOT IN ({_STOP_S}) AND length(w) > 2))"
)
HEAD_WORDS_SQL = f"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP_H}))"


@query(
    "headline_tokens",
    f"""
    SELECT doc_id, array_to_string(list_sort({SEARCH_WORDS_SQL.format(t='t')}), ' ') AS search_words,
      array_to_string({HEAD_WORDS_SQL.format(t='t')}, ' ') AS headline_words,
      array_to_string(list_transform(list_sort(list_transform({SEARCH_WORDS_SQL.format(t='t')}, lambda w: {{'l': -length(w), 'w': w}}))[1:5], lambda s: s.w), ' ') AS longest
    FROM (SELECT doc_id, split_part(text, '.', 1) AS t FROM documents)
    """,
)
def headline_tokens(spark, sf):
    t = F.col("title")
    return documents(spark, sf).select(
        "doc_id",
        F.array_join(F.array_sort(text.search_words(t)), " ").alias("search_words"),
        F.array_join(text.headline_words(t), " ").alias("headline_words"),
        F.array_join(text.longest_words(t), " ").alias("longest"),
    )


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 2500) AS shown FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("body"), text.display_text(F.col("text")).alias("shown"))


@query(
    "clean_html",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '), '\s+', ' ', 'g')) AS title
    FROM (SELECT page_id, '<b>Page ' || page_id || '</b> of &amp; ' || split_part(url, '/', 3) AS h FROM pages)""",
)
def clean_html(spark, sf):
    h = F.concat(F.lit("<b>Page "), F.col("page_id").cast("string"), F.lit("</b> of &amp; "), F.split("url", "/")[2])
    return table(spark, sf, "pages").select("page_id", text.clean_html(h).alias("title"))


@query(
    "party_names",
    r"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || ', ' || c_mktsegment || ' & Co.'), '[^\w\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS party FROM customer",
)
def party_names(spark, sf):
    name = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(" & Co."))
    return table(spark, sf, "customer").select("c_custkey", text.normalize_party(name).alias("party"))


@query(
    "form_scope",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SC 13D' WHEN 1 THEN '8-K' WHEN 2 THEN '10-Q' ELSE 'SC TO-I' END AS form
    FROM orders WHERE o_orderkey % 4 <> 2
    """,
)
def form_scope(spark, sf):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, "schedule  13d").when(k == 1, " 8-k ").when(k == 2, "10-Q").otherwise("SC TO-I")
    o = table(spark, sf, "orders").withColumn("label", label)
    return o.filter(text.in_form_scope(F.col("label"), ["8-K", "SCHEDULE 13D", "SC TO-I"])).select(
        "o_orderkey", text.normalize_form(F.col("label")).alias("form")
    )


@query(
    "registrar_ids",
    "SELECT c_custkey, lpad(c_custkey::varchar, 10, '0') AS cik FROM customer",
)
def registrar_ids(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", ids.normalize_cik(F.concat(F.lit("CIK "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("cik")
    )


@query(
    "publication_dates",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published_date,
      CASE WHEN o_orderkey % 4 <> 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS calendar_day,
      (o_orderdate + INTERVAL 20 HOUR + INTERVAL 8 HOUR)::date AS hkt_day
    FROM orders
    """,
)
def publication_dates(spark, sf):
    k = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(k == 0, F.concat(day, F.lit("T20:00:00+00:00"))).when(k == 2, F.left(day, F.lit(7))).otherwise(day)
    precision = F.when(k == 0, "datetime").when(k == 1, "date").when(k == 2, "month").otherwise("unknown")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        times.publication_date(value, precision).alias("published_date"),
        times.calendar_date(value).alias("calendar_day"),
        times.hkt_date(times.instant(F.concat(day, F.lit("T20:00:00+00:00")))).alias("hkt_day"),
    )


@query(
    "card_stamps",
    """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(ts::date, '%Y-%m-%d') || 'T00:00:00+08:00' END AS stamp
    FROM events
    """,
)
def card_stamps(spark, sf):
    k = F.col("event_id") % 3
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    published = F.when(k == 0, F.concat(iso, F.lit("+00:00"))).when(k == 1, iso)
    return table(spark, sf, "events").select("event_id", times.stamp(published, F.to_date("ts")).alias("stamp"))


# --- amounts ---------------------------------------------------------------------------------
_AMOUNT_BODY = (
    "'$' || (doc_id % 900 + 1) || '.5 billion raised; EUR ' || (doc_id % 999 + 1) || ',000 and £' || (doc_id % 7) || ' m; usd 12 trillion. $' || "
    "(doc_id % 50) || 'm ' || split_part(text, '.', 1)"
)


def _amount_body():
    k = F.col("doc_id")
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit("$"), s(k % 900 + 1), F.lit(".5 billion raised; EUR "), s(k % 999 + 1), F.lit(",000 and £"), s(k % 7),
        F.lit(" m; usd 12 trillion. $"), s(k % 50), F.lit("m "), F.col("title"),
    )


_CLAIM_RE = fv.CLAIM_AMOUNT


@query(
    "amount_claims",
    f"""
    SELECT doc_id || '-amt' || i AS claim_id, doc_id::varchar AS article_id, trim(sp[i]) AS evidence_span,
      replace(num[i], ',', '')::double AS amount,
      CASE upper(cur[i]) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' ELSE upper(cur[i]) END AS currency,
      CASE coalesce(lower(un[i]), '') WHEN '' THEN 'plain' WHEN 'bn' THEN 'billion' WHEN 'mn' THEN 'million' WHEN 'm' THEN 'million' WHEN 'k' THEN 'thousand' ELSE lower(un[i]) END AS unit
    FROM (SELECT *, unnest(range(1, len(sp) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(b, '{_CLAIM_RE}', 0) AS sp, regexp_extract_all(b, '{_CLAIM_RE}', 1) AS cur,
        regexp_extract_all(b, '{_CLAIM_RE}', 2) AS num, regexp_extract_all(b, '{_CLAIM_RE}', 3) AS un
      FROM (SELECT doc_id, {_AMOUNT_BODY} AS b FROM documents)))
    """,
)
def amount_claims(spark, sf):
    a = documents(spark, sf).select(F.col("doc_id").cast("string").alias("article_id"), _amount_body().alias("body"), F.lit("q1").alias("period"))
    return corpus.amount_claims(a).select("claim_id", "article_id", "evidence_span", "amount", "currency", "unit")


_DECISION_CLAIM_SQL = f"""
WITH c AS (SELECT doc_id, b, len(regexp_extract_all(b, '{_CLAIM_RE}', 0)) AS n, regexp_extract_all(b, '{_CLAIM_RE}', 0) AS sp
           FROM (SELECT doc_id, {_AMOUNT_BODY} AS b FROM documents)),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id // 5 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM c)
SELECT doc_id // 5 AS event_id, doc_id || '-amt' || (before + i) AS claim_id, trim(sp[i]) AS evidence_span
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM o)
"""


@query("decision_claims", _DECISION_CLAIM_SQL)
def decision_claims(spark, sf):
    d = documents(spark, sf)
    members = d.select(
        F.floor(F.col("doc_id") / 5).alias("event_id"), (F.col("doc_id") % 5).alias("pos"), F.col("doc_id").cast("string").alias("article_id"), F.lit("q1").alias("period")
    )
    bodies = d.select(F.col("doc_id").cast("string").alias("article_id"), _amount_body().alias("body"))
    return corpus.decision_claims(members, bodies).select("event_id", "claim_id", "evidence_span")


@query(
    "largest_amount",
    rf"""
    SELECT doc_id, greatest(0, coalesce(list_max(list_transform(range(1, len(n) + 1), lambda i:
      try_cast(replace(n[i], ',', '') AS double) * CASE WHEN lower(u[i]) IN ('billion', 'bn', 'b') THEN 1000 ELSE 1 END)), 0))::double AS millions
    FROM (SELECT doc_id, regexp_extract_all(b, '{fv.USD_AMOUNT}', 1) AS n, regexp_extract_all(b, '{fv.USD_AMOUNT}', 2) AS u
          FROM (SELECT doc_id, {_AMOUNT_BODY} AS b FROM documents))
    """,
)
def largest_amount(spark, sf):
    return documents(spark, sf).select("doc_id", money.largest_usd_millions(_amount_body()).alias("millions"))


_FACT_BODY = "(doc_id % 90) || '.25亿 and ' || (doc_id % 13) || ' billion, ' || (doc_id % 30) || '% of 1,200 plus ' || (doc_id % 4) || ' banks'"


@query(
    "numeric_facts",
    f"""
    SELECT DISTINCT doc_id, kind, value FROM (
      SELECT doc_id, CASE WHEN u[i] IN ('%', 'percent') THEN 'percent' WHEN u[i] = '' THEN 'plain' ELSE 'amount' END AS kind,
        round(replace(n[i], ',', '')::double * CASE u[i] WHEN '亿' THEN 1e8 WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 ELSE 1 END, 6) AS value
      FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(b, '{fv.FACT_NUMBER}', 1) AS n, list_transform(regexp_extract_all(b, '{fv.FACT_NUMBER}', 2), lambda x: coalesce(lower(x), '')) AS u
        FROM (SELECT doc_id, {_FACT_BODY} AS b FROM documents))))
    """,
)
def numeric_facts(spark, sf):
    k = F.col("doc_id")
    s = lambda c: c.cast("string")
    body = F.concat(s(k % 90), F.lit(".25亿 and "), s(k % 13), F.lit(" billion, "), s(k % 30), F.lit("% of 1,200 plus "), s(k % 4), F.lit(" banks"))
    return documents(spark, sf).select("doc_id", F.explode(money.numeric_facts(body)).alias("f")).select("doc_id", "f.kind", "f.value")


@query(
    "currency_hedges",
    """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP|USD' ELSE '' END AS codes,
      contains(lower(text), 'may') OR contains(lower(text), 'could') OR contains(lower(text), 'expected') OR contains(lower(text), 'alleged')
      OR contains(lower(text), 'proposed') OR contains(lower(text), 'reportedly') OR contains(lower(text), 'unconfirmed') OR contains(lower(text), 'not ')
      OR contains(lower(text), 'no ') OR contains(lower(text), 'denied') OR contains(lower(text), 'if ') AS hedged
    FROM documents
    """,
)
def currency_hedges(spark, sf):
    k = F.col("doc_id") % 3
    amount = F.when(k == 0, "欧元 5").when(k == 1, "USD 5, £3").otherwise("none")
    return documents(spark, sf).select(
        "doc_id", F.array_join(money.currencies(amount), "|").alias("codes"), money.hedged(F.col("text"), fv.ENGLISH_HEDGES).alias("hedged")
    )


# --- baseline --------------------------------------------------------------------------------
_SECTORS = {"private_credit": ["ththe", "tion"], "software": ["schung", "ciónes"]}
_BASE_BODY = (
    "text || CASE doc_id % 6 WHEN 0 THEN ' The lender reported a default of $2 billion.' WHEN 1 THEN ' Final close: fund raised $300 million' "
    "WHEN 2 THEN ' Fed weighs rate cut, revised' WHEN 3 THEN ' an award' ELSE '' END"
)


def _base_articles(spark, sf):
    k = F.col("doc_id")
    tail = (
        F.when(k % 6 == 0, " The lender reported a default of $2 billion.")
        .when(k % 6 == 1, " Final close: fund raised $300 million")
        .when(k % 6 == 2, " Fed weighs rate cut, revised")
        .when(k % 6 == 3, " an award")
        .otherwise("")
    )
    return documents(spark, sf).select(
        k.alias("article_id"),
        F.lit("").alias("title"),
        F.concat("text", tail).alias("body"),
        F.lit("https://x.example/").alias("canonical_url"),
        F.when(k % 3 == 0, "filing").when(k % 3 == 1, "independent_reporting").otherwise("other").alias("source_kind"),
        F.when(k % 11 == 0, "unavailable").otherwise("accessible").alias("access_status"),
        F.lit("full_text").alias("evidence_scope"),
        F.lit(None).cast("string").alias("event_date"),
    )


_TYPE_SQL = "CASE " + " ".join(
    f"WHEN {word_sql([p.replace('-', chr(92) + '-') for p in phrases], 'b')} THEN '{name}'" for name, _, phrases in fv.EVENT_PHRASES
) + " ELSE 'other' END"
_ROUTINE_SQL = " OR ".join(f"contains(lower(b), '{p}')" for p in fv.ROUTINE_PHRASES)
_SECTOR_SQL = "concat_ws('|', " + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(b), '{t}')" for t in terms) + f" THEN '{k}' END" for k, terms in _SECTORS.items()
) + ")"
_PROPOSE_SQL = rf"""
WITH a AS (SELECT doc_id, {_BASE_BODY} AS b FROM documents),
t AS (SELECT doc_id, {_TYPE_SQL} AS kind, {_SECTOR_SQL} AS sectors, ({_ROUTINE_SQL}) AS routine,
  CASE doc_id % 6 WHEN 0 THEN 2000 WHEN 1 THEN 300 ELSE 0 END AS amount, regexp_matches(b, '(?i)\bupdate[ds]?\b|\brevised\b|\bcorrection\b') AS upd FROM a),
l AS (SELECT *, CASE WHEN sectors <> '' THEN 'B' WHEN kind IN ('macro_policy', 'market_conditions') THEN 'C' END AS lvl FROM t)
SELECT doc_id AS article_id, kind AS primary_event_type, sectors, lvl AS relevance_level,
  CASE lvl WHEN 'B' THEN 25 WHEN 'C' THEN 20 ELSE 0 END AS fit,
  CASE WHEN routine OR kind = 'other' THEN 5 WHEN kind IN ('credit_stress', 'regulatory') OR amount >= 1000 THEN 20
       WHEN amount > 0 OR kind IN ('financial_results', 'structured_finance', 'capital_formation') THEN 15 ELSE 5 END AS materiality,
  CASE WHEN lvl = 'B' AND kind <> 'other' THEN 10 WHEN lvl IS NOT NULL THEN 5 ELSE 0 END AS transmission,
  CASE WHEN doc_id % 11 = 0 THEN 4 WHEN doc_id % 3 = 0 THEN 10 WHEN doc_id % 3 = 1 THEN 7 ELSE 4 END AS credibility,
  CASE WHEN upd THEN 2 ELSE 5 END AS novelty
FROM l
"""


@query("baseline_proposals", _PROPOSE_SQL)
def baseline_proposals(spark, sf):
    p = baseline.propose(_base_articles(spark, sf), _SECTORS)
    pts = lambda n: F.col("components")[n]["points"]
    return p.select(
        "article_id", "primary_event_type", F.array_join("sector_ids", "|").alias("sectors"), "relevance_level",
        pts("portfolio_fit").alias("fit"), pts("materiality").alias("materiality"), pts("investment_transmission").alias("transmission"),
        pts("source_credibility").alias("credibility"), pts("novelty").alias("novelty"),
    )


#: The dictionary of the entity query: the first word or two of every benchmark item, some of them conditional, excluded or with an official host.
_NAMES_SQL = r"""
SELECT item_id AS entity, row_number() OVER (ORDER BY item_id) - 1 AS place, CASE WHEN length(text) % 2 = 0 THEN w[1] || ' ' || w[2] ELSE w[1] END AS name, length(text) % 2 <> 0 AS single,
  length(text) % 3 = 0 AS conditional, length(text) % 7 = 0 AS official, CASE WHEN length(text) % 5 = 0 THEN w[5] END AS excluded
FROM (SELECT item_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark) WHERE len(w) >= 5
"""


def _names(spark, sf):
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    size = F.length("text")
    b = table(spark, sf, "benchmark").withColumn("w", w).filter(F.size("w") >= 5)
    name = F.when(size % 2 == 0, F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))).otherwise(F.get("w", F.lit(0)))
    kinds = F.array(F.struct(F.lit("name").alias("kind"), name.alias("name")), F.struct(F.lit("excluded").alias("kind"), F.when(size % 5 == 0, F.get("w", F.lit(4))).alias("name")))
    rows = rank_all(b, [F.col("item_id").asc()], rank_col="nth").select("item_id", "nth", (size % 3 == 0).alias("conditional"), (size % 7 == 0).alias("official"), F.explode(kinds).alias("k"))
    return rows.filter("k.name IS NOT NULL").select(
        F.col("item_id").cast("string").alias("entity"), (F.col("nth") - 1).alias("entity_place"), "k.kind", F.lit(0).cast("long").alias("place"), "k.name", "conditional",
        F.lit(None).cast("string").alias("parent"), F.when(F.col("official"), F.array(F.lit("x.example"))).otherwise(F.array().cast("array<string>")).alias("domains"), F.lit("").alias("exchange"),
    )


@query(
    "entity_mentions",
    rf"""
    WITH n AS ({_NAMES_SQL}), x AS (
      SELECT doc_id, text, n.*, '(?is)^(.*?(?:^|[^\p{{L}}\p{{N}}_]))' || name || '(?:[^\p{{L}}\p{{N}}_]|$)' AS pattern FROM documents, n WHERE contains(lower(text), lower(name))),
    f AS (SELECT *, length(regexp_extract(text, pattern, 1)) AS start, start + length(name) AS stop FROM x WHERE regexp_matches(text, pattern)),
    s AS (SELECT *, lower(coalesce(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_matches(y, pattern))[1], text)) AS around FROM f),
    h AS (SELECT *, excluded IS NOT NULL AND regexp_matches(text, '(?is)(^|[^\p{{L}}\p{{N}}_])' || excluded || '([^\p{{L}}\p{{N}}_]|$)') AS out,
      NOT conditional OR official OR NOT single OR {" OR ".join(f"contains(around, '{t}')" for t in fv.CREDIT_CONTEXT)} AS sure FROM s)
    SELECT doc_id AS article_id, entity::varchar AS entity, substr(text, start + 1, length(name)) AS matched, start::int AS start, stop::int AS stop, CASE WHEN conditional THEN 'ER06/ER07/ER08' ELSE 'ER01' END AS rule,
      official, CASE WHEN over IS NOT NULL THEN 'suppressed_by_longer_name' WHEN out THEN 'excluded' WHEN sure THEN 'resolved' ELSE 'ambiguous' END AS status, over AS suppressed_by
    FROM (SELECT h.*, (SELECT arg_min(o.entity::varchar, o.place) FROM h o WHERE o.doc_id = h.doc_id AND o.start <= h.start AND o.stop >= h.stop AND o.stop - o.start > h.stop - h.start) AS over FROM h)
    """,
)
def entity_mentions(spark, sf):
    """Every dictionary name in every text: span, rule, status and the longer name that covers it."""
    d = documents(spark, sf).select(F.col("doc_id").alias("article_id"), "text", F.lit("https://x.example/a").alias("url"))
    hits = with_entities(d, "article_id", "text", "url", _names(spark, sf)).select("article_id", F.explode("entity_matches").alias("h"))
    return hits.select(
        "article_id", F.col("h.canonical_id").alias("entity"), F.col("h.matched_text").alias("matched"), "h.start", F.col("h.end").alias("stop"), "h.rule", F.col("h.official_host").alias("official"), "h.status", "h.suppressed_by"
    )


@query(
    "theme_candidates",
    f"""
    SELECT article_id, array_to_string(list_sort(list_distinct(list(theme))), '|') AS themes FROM (
      SELECT article_id, unnest(string_split(sectors, '|')) AS s FROM ({_PROPOSE_SQL}) WHERE sectors <> '') p
    JOIN (VALUES ('stress', 'private_credit'), ('ai', 'software'), ('liquidity', 'private_credit'), ('liquidity', 'software')) t(theme, s) USING (s)
    GROUP BY article_id
    """,
)
def theme_candidates(spark, sf):
    themes = spark.createDataFrame(
        [("stress", "private_credit"), ("ai", "software"), ("liquidity", "private_credit"), ("liquidity", "software")], "theme_id string, sector_id string"
    )
    p = baseline.propose(_base_articles(spark, sf), _SECTORS)
    return baseline.linkable_themes(p, themes, "article_id").select("article_id", F.array_join("theme_candidates", "|").alias("themes"))


@query(
    "ancestors",
    """
    WITH RECURSIVE e AS (
      SELECT 'n' || n_nationkey AS entity, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
    up AS (SELECT entity, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT u.entity, e.parent, u.depth + 1 FROM up u JOIN e ON e.entity = u.ancestor)
    SELECT entity, ancestor, depth FROM up
    """,
)
def ancestors(spark, sf):
    n = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent")
    )
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("entity"), F.lit("world").alias("parent"))
    return baseline.ancestors(n.unionByName(r))

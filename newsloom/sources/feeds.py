"""Landed feed payloads to entries: RSS, Atom filings, sitemaps and JSON article lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import times
from newsloom.functions.text import clean_html, squeeze

RSS = (
    "channel struct<title:string, item:array<struct<title:string, link:string, pubDate:string, "
    "description:string, source:struct<_VALUE:string,_url:string>>>>"
)
ATOM = (
    "entry array<struct<category:struct<_term:string>, link:struct<_href:string>, updated:string, "
    "content:struct<`items-desc`:string>>>"
)
SITEMAP = "url array<struct<loc:string, lastmod:string>>"
ARTICLES = "articles array<struct<url:string, title:string, seendate:string, domain:string>>"
_PERMISSIVE = {"mode": "PERMISSIVE"}


def _items(payloads: DataFrame, parsed: Column, path: str) -> DataFrame:
    kept = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*kept, parsed.alias("_doc")).select(*kept, "_doc", F.explode(path).alias("_i"))


def parse_rss(payloads: DataFrame) -> DataFrame:
    """RSS 2.0 payloads (feed, payload, …) to title, url, publisher, published, description.

    A trailing " - Publisher" is cut, undated items are dropped, and a description that only repeats
    the headline is blanked.
    """
    kept = [c for c in payloads.columns if c != "payload"]
    rows = _items(payloads, F.from_xml(F.col("payload"), RSS, _PERMISSIVE), "_doc.channel.item")
    rows = rows.select(
        *kept,
        clean_html(F.col("_i.title")).alias("_title"),
        F.trim(F.coalesce("_i.link", F.lit(""))).alias("url"),
        clean_html(F.coalesce(F.when(F.col("_i.source._VALUE") != "", F.col("_i.source._VALUE")), F.col("_doc.channel.title"))).alias("_pub"),
        times.rfc822(F.col("_i.pubDate")).alias("published"),
        clean_html(F.col("_i.description")).alias("_desc"),
    )
    suffix = F.concat(F.lit(" - "), "_pub")
    cut = F.when(
        (F.col("_pub") != "") & F.col("_title").endswith(suffix),
        F.trim(F.left("_title", F.length("_title") - F.length(suffix))),
    ).otherwise(F.col("_title"))
    rows = rows.withColumn("title", cut)
    return rows.filter(F.col("published").isNotNull() & (F.col("title") != "") & (F.col("url") != "")).select(
        *kept,
        "title",
        "url",
        F.when(F.col("_pub") != "", F.col("_pub")).otherwise(fv.UNKNOWN_PUBLISHER).alias("publisher"),
        "published",
        F.when(F.col("_desc").startswith(F.col("title")), "").otherwise(F.col("_desc")).alias("description"),
    )


def parse_filings(payloads: DataFrame, registrants: DataFrame) -> DataFrame:
    """Atom filing feeds joined to their registrant (feed, name, gps): one entry per filing."""
    rows = _items(payloads, F.from_xml(F.col("payload"), ATOM, _PERMISSIVE), "_doc.entry")
    kept = [c for c in payloads.columns if c != "payload"]
    rows = rows.join(registrants, "feed")
    items = F.coalesce(F.col("_i.content.items-desc"), F.lit(""))
    form, link = F.col("_i.category._term"), F.col("_i.link._href")
    title = F.concat("name", F.lit(" files "), form, F.when(items != "", F.concat(F.lit(": "), items)).otherwise(""))
    return rows.filter((form != "") & (link != "")).select(
        *kept,
        title.alias("title"),
        link.alias("url"),
        F.col("name").alias("publisher"),
        F.try_to_timestamp("_i.updated").alias("published"),
        F.lit("").alias("description"),
        form.alias("form"),
        F.lit("issuer_filing").alias("origin"),
        "gps",
    ).filter(F.col("published").isNotNull())


def parse_sitemap(payloads: DataFrame, prefix: str, publisher: str) -> DataFrame:
    """Official release sitemap: kept prefix, title from the slug, dated by modification time."""
    rows = _items(payloads, F.from_xml(F.col("payload"), SITEMAP, _PERMISSIVE), "_doc.url")
    kept = [c for c in payloads.columns if c != "payload"]
    url = F.trim(F.coalesce("_i.loc", F.lit("")))
    slug = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    number = F.regexp_extract(slug, r"^(\d+-\d+mr)-(.+)", 1)
    words = F.when(number != "", F.regexp_extract(slug, r"^(\d+-\d+mr)-(.+)", 2)).otherwise(slug)
    tag = F.when(number != "", F.concat(F.lit(" "), F.upper(number), F.lit(": "))).otherwise(F.lit(": "))
    return rows.select(
        *kept,
        F.concat(F.lit(publisher), tag, F.translate(words, "-", " ")).alias("title"),
        url.alias("url"),
        F.lit(publisher).alias("publisher"),
        F.try_to_timestamp(F.trim("_i.lastmod")).alias("published"),
        F.lit("").alias("description"),
        F.lit("sitemap_lastmod").alias("published_basis"),
    ).filter(F.col("url").startswith(prefix) & F.col("published").isNotNull())


def join_tokens(title: Column) -> Column:
    """Undo the spacing of a tokenised headline ("$2 . 5 billion , says")."""
    t = F.regexp_replace(title, r"(\d) \. (\d)", "$1.$2")
    t = F.regexp_replace(t, r"(?U)\s+([.,%:;!?)\]])", "$1")
    return squeeze(F.regexp_replace(t, r"(?U)([(\[$])\s+", "$1"))


def parse_article_list(payloads: DataFrame) -> DataFrame:
    """JSON search results: real publisher URLs, dated by their first sighting."""
    rows = _items(payloads, F.from_json(F.col("payload"), ARTICLES), "_doc.articles")
    kept = [c for c in payloads.columns if c != "payload"]
    domain = F.col("_i.domain")
    return rows.select(
        *kept,
        join_tokens(F.col("_i.title")).alias("title"),
        F.col("_i.url").alias("url"),
        F.coalesce(F.when(domain != "", domain), F.lit(fv.UNKNOWN_PUBLISHER)).alias("publisher"),
        F.try_to_timestamp("_i.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("published"),
        F.lit("").alias("description"),
        F.lit("gdelt").alias("discovery"),
        F.lit("gdelt_seen").alias("published_basis"),
    ).filter(F.col("published").isNotNull() & F.col("url").rlike("^https?://") & (F.col("title") != ""))


def failed_payloads(payloads: DataFrame, kind: str) -> DataFrame:
    """Payloads that hold no document of their kind; one failing feed never stops the others."""
    roots = {"rss": r"(?s)<channel[\s>]", "atom": r"(?s)<feed[\s>]", "sitemap": r"(?s)<urlset[\s>]", "articles": r"(?s)^\s*\{"}
    ok = F.coalesce(F.col("payload").rlike(roots[kind]), F.lit(False))
    limited = F.coalesce(F.ltrim("payload").startswith("Please limit requests"), F.lit(False))
    return payloads.filter(~ok).select("feed", F.when(limited, "rate limit").otherwise(F.left("payload", F.lit(120))).alias("reason"))

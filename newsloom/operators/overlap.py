"""Headline overlap: candidates found by a search, similarity joins, source verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import ids
from newsloom.functions.text import headline_words, search_words
from newsloom.operators.skew import first_by, top_k


def overlap_score(wanted: Column, found: Column) -> Column:
    """Share of the wanted headline's words that the found title contains."""
    return F.size(F.array_intersect(wanted, found)) / F.greatest(F.lit(1), F.size(wanted))


def score_candidates(cards: DataFrame, results: DataFrame, threshold: float) -> DataFrame:
    """Search results of each card above a share of its headline words; blocked hosts are out.

    ``cards``: card_id, headline.  ``results``: card_id, url, title.  One equi-join on card_id.
    """
    wanted = cards.select("card_id", search_words(F.col("headline")).alias("_wanted"))
    open_hosts = results.filter(F.col("url").isNotNull() & F.col("title").isNotNull()).filter(
        ~ids.host_in(F.col("url"), fv.SEARCH_BLOCKED_HOSTS)
    )
    scored = open_hosts.join(wanted, "card_id").withColumn(
        "score", overlap_score(F.col("_wanted"), search_words(F.col("title")))
    )
    return scored.filter(F.col("score") >= threshold).drop("_wanted")


def best_candidate(cards: DataFrame, results: DataFrame, threshold: float = fv.BACKFILL_OVERLAP) -> DataFrame:
    """The best result per card by (score, url), highest first."""
    scored = score_candidates(cards, results, threshold)
    return scored.groupBy("card_id").agg(
        F.max_by(F.struct("url", "score"), F.struct("score", "url")).alias("_b")
    ).select("card_id", "_b.url", "_b.score")


def _usable_link(url: Column) -> Column:
    """http(s) only, no credentials, no local or private literal address."""
    h = ids.host(url)
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    user = F.try_parse_url(url, F.lit("USERINFO"))
    private = h.rlike(
        r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|"
        r"192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(4\d|5[0-5])\.)"
    ) & h.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    local_v6 = h.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$")
    return (
        scheme.isin("http", "https")
        & F.coalesce(user, F.lit("")).eqNullSafe("")
        & ~h.isin("localhost", fv.AGGREGATOR_HOST)
        & ~private
        & ~local_v6
    )


def top_candidates(cards: DataFrame, results: DataFrame, threshold: float = fv.SEARCH_OVERLAP, k: int = 3) -> DataFrame:
    """The first k search results per card by score; equal scores keep the result order (``pos``)."""
    usable = results.filter(F.coalesce(_usable_link(F.col("url")), F.lit(False)))
    scored = score_candidates(cards, usable, threshold)
    return top_k(scored, ["card_id"], [F.col("score").desc(), F.col("pos").asc()], k).select(
        "card_id", "rank", "url", "title", ids.host(F.col("url")).alias("publisher"), F.round("score", 3).alias("score")
    )


def verify_sources(options: DataFrame, first: int = 3) -> DataFrame:
    """Status of each candidate page, and per card the first verified one of the first three.

    ``options``: card_id, rank, headline, card_date, level, status, page_title, source_published_at.
    """
    title_score = overlap_score(
        search_words(F.col("headline")), search_words(F.coalesce("page_title", F.lit("")))
    )
    day = F.to_date(F.try_to_timestamp(F.left("source_published_at", F.lit(10)), F.lit("yyyy-MM-dd")))
    near = F.coalesce(F.abs(F.datediff(day, F.col("card_date"))) <= 7, F.lit(False))
    dated = F.col("source_published_at").isNotNull() & (F.col("source_published_at") != "")
    read = F.col("level") == "excerpt"
    close = F.col("title_score") >= fv.SEARCH_OVERLAP
    checked = options.filter(F.col("rank") <= first).withColumn("title_score", title_score)
    return checked.withColumn(
        "verdict",
        F.when(read & close & dated & near, "verified")
        .when(read & close & ~dated, "review_date")
        .when(read, "mismatch")
        .otherwise(F.coalesce("status", F.lit("error"))),
    )


def best_source(verified: DataFrame) -> DataFrame:
    return first_by(verified.filter(F.col("verdict") == "verified"), ["card_id"], [F.col("rank")], ["rank", "title_score"])


def _by_rarity(sets: DataFrame, freq: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """Replace the word array ``w`` by the same words, rarest first (ties by the word)."""
    exploded = sets.select(key, *extra, F.explode("w").alias("word")).join(freq, "word", "left")
    packed = exploded.groupBy(key, *extra).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word")))).alias("s")
    )
    return packed.select(key, *extra, F.transform("s", lambda x: x["word"]).alias("w"))


def contained_headlines(
    wanted: DataFrame, found: DataFrame, threshold: float = fv.BACKFILL_OVERLAP
) -> DataFrame:
    """All (wanted, found) pairs whose overlap reaches the threshold, exactly.

    ``wanted``: id, title.  ``found``: id, title.  Prefix filter: to share at least ceil(t*|A|) words a
    pair must share one of the |A| - ceil(t*|A|) + 1 rarest words of A.  Only those words of A meet the
    index of found words, so frequent words hardly ever form pairs; each pair is verified once, at the
    first shared prefix word.
    """
    a = wanted.select(F.col("id").alias("a"), search_words(F.col("title")).alias("w")).filter(F.size("w") > 0)
    b = found.select(F.col("id").alias("b"), search_words(F.col("title")).alias("wb")).filter(F.size("wb") > 0)
    posting = b.select("b", "wb", F.explode("wb").alias("word"))
    freq = b.select(F.explode("wb").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = _by_rarity(a, freq, "a", [])
    need = F.ceil(F.size("w") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    prefix = F.slice("w", F.lit(1), F.size("w") - need + 1)
    probes = ranked.withColumn("prefix", prefix).select("a", "w", "prefix", F.explode("prefix").alias("word"))
    pairs = probes.join(posting, "word").filter(
        F.element_at(F.array_intersect("prefix", "wb"), 1) == F.col("word")
    )
    return pairs.withColumn("score", overlap_score(F.col("w"), F.col("wb"))).filter(F.col("score") >= threshold).select(
        "a", "b", "score"
    )


def story_signatures(titles: DataFrame) -> DataFrame:
    """Distinct (lead word, word set) signatures with their number of headlines and smallest id."""
    words = headline_words(F.col("title"))
    return (
        titles.select("id", words.alias("all"))
        .filter(F.size("all") > 0)
        .select("id", F.get("all", F.lit(0)).alias("lead"), F.array_sort(F.array_distinct("all")).alias("w"))
        .groupBy("lead", "w")
        .agg(F.min("id").alias("sig"), F.count("*").alias("headlines"))
    )


def same_story_pairs(titles: DataFrame, threshold: float = fv.SAME_STORY_JACCARD) -> DataFrame:
    """Pairs of distinct headline signatures with one lead word and Jaccard >= threshold.

    Equal headlines share a signature (see :func:`story_signatures`), so any number of copies is one row
    here and no group of copies is ever paired with itself.  Jaccard >= t needs a shared word among the
    |A| - ceil(t*|A|) + 1 rarest of both sides, so the join runs on (lead word, rare word).
    """
    sigs = story_signatures(titles)
    freq = sigs.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = _by_rarity(sigs, freq, "sig", ["lead", "headlines"])
    need = F.ceil(F.size("w") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    p = ranked.withColumn("p", F.slice("w", F.lit(1), F.size("w") - need + 1))
    side = p.select("sig", "lead", "headlines", "w", "p", F.explode("p").alias("word"))
    left = side.select("lead", "word", *[F.col(c).alias(f"{c}_a") for c in ("sig", "headlines", "w", "p")])
    right = side.select("lead", "word", *[F.col(c).alias(f"{c}_b") for c in ("sig", "headlines", "w", "p")])
    met = left.join(right, ["lead", "word"]).filter(F.col("sig_a") < F.col("sig_b"))
    once = met.filter(F.element_at(F.array_intersect("p_a", "p_b"), 1) == F.col("word"))
    score = F.size(F.array_intersect("w_a", "w_b")) / F.size(F.array_union("w_a", "w_b"))
    return once.withColumn("jaccard", score).filter(F.col("jaccard") >= threshold).select(
        "sig_a", "sig_b", "headlines_a", "headlines_b", "jaccard"
    )

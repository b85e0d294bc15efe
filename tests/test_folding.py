"""Texts are folded, and searched for amounts and updates, only as far as they need it."""

from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.money import largest_usd_millions
from newsloom.functions.text import contains_any, fold

TEXTS = ["Plain TEXT", "İstanbul ılık", "reviſed Kind", "", None, "Straße ÀÉ", "UPDATES, corrections", "a Correction: us$ 3 bn, $5m", "reviſed", "US$1,000 million", "no amount 5 million"]


def test_same_values(spark):
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in TEXTS], "t string").select(
        fold(t).alias("fold"), F.lower(F.translate(t, "İıſK", "iisk")).alias("plain"), largest_usd_millions(t).alias("amount"),
        (contains_any(fold(t), fv.UPDATE_STEMS) & t.rlike("(?U)" + fv.UPDATE_WORDING)).alias("guarded"), t.rlike("(?U)" + fv.UPDATE_WORDING).alias("update"),
    ).collect()
    assert all(r["fold"] == r["plain"] and r["guarded"] == r["update"] for r in rows)
    assert [r["amount"] for r in rows] == [0, 0, 0, 0, 0, 0, 0, 3000, 0, 1000, 0]
    assert sum(bool(r["update"]) for r in rows) == 4


def test_plain_texts_are_not_taken_apart(spark):
    """Translation and the amounts' expression stand behind a search, as in most texts there is nothing for them."""
    for made, work in ((fold(F.col("t")), "translate("), (largest_usd_millions(F.col("t")), "regexp_extract_all(")):
        plan = str(made)
        assert "contains(t" in plan[: plan.index(work)] or "contains(coalesce(t" in plan[: plan.index(work)]

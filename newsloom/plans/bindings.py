"""How the supplied tables stand in for articles, entries, decisions and ledgers.

The supplied text is invented, so rule terms are frequent words of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.rules import RuleSet, Tag
from newsloom.plans.registry import table

RULES = RuleSet(
    gps={
        "alpha": Tag(("avec", "thon the")),
        "beta": Tag(("MIT", "GNU", "THE")),
        "gamma": Tag(("la", "un", "der"), needs_context=True),
    },
    sectors={"north": Tag(("than", "for")), "south": Tag(("una", "ist"), needs_context=True)},
    context=("que", "des", "thes", "sch"),
    event=("was", "is", "en", "est"),
    exclude=("ndly", "SS", "oi"),
)

TITLE = "split_part(text, '.', 1)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents as articles: title before the first full stop, 60 publication days."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text"),
        "lang",
        "source",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("day"),
    )


def word_sql(terms, column="text") -> str:
    """RE2 whole-word test with the same case rule as the library."""
    exact = [t for t in terms if t.isupper()]
    loose = [t for t in terms if not t.isupper()]
    parts = ([f"(?:{'|'.join(exact)})"] if exact else []) + ([f"(?i:{'|'.join(loose)})"] if loose else [])
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({column}, '(^|{edge})(?:{'|'.join(parts)})({edge}|$)')"

"""Event identity of a headline and of a validated story."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.text import clean_text, normalize_title


def headline_key(source_headline: Column) -> Column:
    """Normalised headline when it carries a figure, a quarter or a month; null otherwise."""
    anchored = source_headline.rlike("(?U)" + fv.ANCHOR_TOKEN)
    return F.when((source_headline != "") & anchored, normalize_title(source_headline))


def validate_identity(raw: Column, title: Column, text: Column) -> Column:
    """Four fields of three or more characters, each verbatim in the source; figures sorted, unique."""
    source = F.concat(clean_text(title), F.lit("\n"), clean_text(text))
    fields = ["subject", "action", "object", "period"]
    ok = raw.isNotNull()
    for f in fields:
        ok = ok & raw[f].isNotNull() & (F.length(F.trim(raw[f])) >= 3) & source.contains(raw[f])
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(f"({fv.IDENTITY_NUMBER})"), 1)))
    identity = F.struct(
        *[normalize_title(raw[f]).alias(f) for f in fields],
        numbers.alias("numbers"),
        F.lit(fv.IDENTITY_VERSION).alias("version"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), identity)


def display_tags(tags: Column, title: Column, repairs: list[dict]) -> Column:
    """Apply child/parent tag repairs.

    Each repair is ``{"child", "parent", "when", "unless"}``: a title that matches ``when`` and not
    ``unless`` names the parent's other vehicle, so the child tag is wrong; otherwise a child tag
    implies its parent.
    """
    out = tags
    for rule in repairs:
        child, parent = rule["child"], rule["parent"]
        other = title.rlike("(?i)" + rule["when"]) & ~title.rlike("(?i)" + rule["unless"])
        bare = F.array_remove(out, child)
        add = lambda xs, p=parent: F.when(F.array_contains(xs, p), xs).otherwise(F.array_append(xs, F.lit(p)))
        out = F.when(F.coalesce(other, F.lit(False)), add(bare)).when(F.array_contains(out, child), add(out)).otherwise(out)
    return out

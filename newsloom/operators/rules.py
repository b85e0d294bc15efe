"""Keyword rules supplied as a table: which entries to keep, with which tags, and why."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import fold, has_term, term_pattern

MAX_TERMS = 20_000


@dataclass(frozen=True)
class Tag:
    terms: tuple[str, ...]
    needs_context: bool = False


@dataclass(frozen=True)
class RuleSet:
    """Keyword rule: two tag groups, context, event and exclusion terms, all in listed order."""

    gps: dict[str, Tag] = field(default_factory=dict)
    sectors: dict[str, Tag] = field(default_factory=dict)
    context: tuple[str, ...] = ()
    event: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @classmethod
    def from_config(cls, config: dict) -> RuleSet:
        """From a rule document (``spark.read.text(..., wholetext=True)`` plus ``json.loads``)."""

        def tags(group):
            return {
                key: Tag(tuple(spec["match"]), bool(spec.get("credit_context_required")))
                for key, spec in config.get(group, {}).items()
            }

        return cls(
            gps=tags("gps"),
            sectors=tags("sectors"),
            context=tuple(config.get("credit_context_keywords", ())),
            event=tuple(config.get("material_event_keywords", ())),
            exclude=tuple(config.get("exclude_keywords", ())),
        )

    @classmethod
    def from_table(cls, terms: DataFrame) -> RuleSet:
        """From the dimension table (group, key, term, ord, context_required); size is checked."""
        rows = terms.select("group", "key", "term", "ord", "context_required").limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValueError(f"rule table exceeds {MAX_TERMS} terms; use match_terms_by_join")
        rows.sort(key=lambda r: r["ord"])

        def tags(group):
            out: dict[str, list] = {}
            context: dict[str, bool] = {}
            for r in rows:
                if r["group"] == group:
                    out.setdefault(r["key"], []).append(r["term"])
                    context[r["key"]] = context.get(r["key"], False) or bool(r["context_required"])
            return {k: Tag(tuple(v), context[k]) for k, v in out.items()}

        def flat(group):
            return tuple(r["term"] for r in rows if r["group"] == group)

        return cls(tags("gps"), tags("sectors"), flat("context"), flat("event"), flat("exclude"))

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows, n = [], 0
        for group in ("gps", "sectors"):
            for key, tag in getattr(self, group).items():
                for term in tag.terms:
                    rows.append((group, key, term, n, tag.needs_context))
                    n += 1
        for group in ("context", "event", "exclude"):
            for term in getattr(self, group):
                rows.append((group, group, term, n, False))
                n += 1
        return spark.createDataFrame(
            rows, '`group` string, key string, term string, ord int, context_required boolean'
        )


def _tag_hits(text: Column, tags: dict[str, Tag], context: Column, folded: Column) -> Column:
    if not tags:
        return F.array().cast("array<string>")
    hits = []
    for key, tag in tags.items():
        hit = has_term(text, tag.terms, folded)
        hits.append(F.when(hit & context if tag.needs_context else hit, F.lit(key)))
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


def _first_excluded(text: Column, terms: tuple[str, ...], folded: Column) -> Column:
    first = F.lit(None).cast("string")
    for term in reversed(terms):
        first = F.when(has_term(text, [term], folded), F.lit(term)).otherwise(first)
    return first


def rule_match(df: DataFrame, rules: RuleSet, text: str = "text") -> DataFrame:
    """Add gps, sectors, reason, keep.

    Tests run in the rule's order: excluded, then no subject, then no event.  One alternation per tag
    keeps every row inside a single JVM pass; the per-term exclusion ladder runs only on excluded rows.
    """
    t, low = F.col(text), F.col("_fold")
    tagged = df.withColumn("_fold", fold(t))
    context = has_term(t, rules.context, low) if rules.context else F.lit(False)
    tagged = tagged.withColumn("_context", context)
    tagged = tagged.withColumns(
        {
            "gps": _tag_hits(t, rules.gps, F.col("_context"), low),
            "sectors": _tag_hits(t, rules.sectors, F.col("_context"), low),
        }
    )
    excluded = has_term(t, rules.exclude, low) if rules.exclude else F.lit(False)
    event = has_term(t, rules.event, low) if rules.event else F.lit(False)
    reason = (
        F.when(excluded, F.concat(F.lit("excluded: "), _first_excluded(t, rules.exclude, low)))
        .when((F.size("gps") == 0) & (F.size("sectors") == 0), "no tracked manager or sub-sector")
        .when(~event, "no material event")
        .otherwise("matched")
    )
    return (
        tagged.withColumn("reason", reason)
        .withColumn("keep", F.col("reason") == "matched")
        .drop("_fold", "_context")
    )


def apply_origin(df: DataFrame, origin: str = "origin", tags: str | None = None) -> DataFrame:
    """A filing is always kept with its registrant's tags; a regulator's release needs no event verb."""
    filing = F.coalesce(F.col(origin) == "issuer_filing", F.lit(False))
    release = F.coalesce(F.col(origin) == "regulator", F.lit(False)) & (F.col("reason") == "no material event")
    none = F.array().cast("array<string>")
    own = F.col(tags) if tags else F.col("gps")
    return df.withColumns(
        {
            "gps": F.when(filing, own).otherwise(F.col("gps")),
            "sectors": F.when(filing, none).otherwise(F.col("sectors")),
            "keep": filing | release | F.col("keep"),
            "reason": F.when(filing, "primary filing").when(release, "regulator release").otherwise(F.col("reason")),
        }
    )


def match_terms_by_join(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """Whole-word hits (key, term) for dictionaries too large for a regular expression.

    Every text becomes its distinct word n-grams and meets the dictionary in one equi-join, so work
    grows with text plus dictionary, not with their product.  Terms are compared as word sequences.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(\w+)"), 1)
    tokens = docs.select(F.col(key), words.alias("w")).filter(F.size("w") > 0)

    def grams_of(n):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    # The lengths that occur: as many rows as different term lengths.
    size = F.size(F.regexp_extract_all(F.lower("term"), F.lit(r"(?U)(\w+)"), 1))
    lengths = sorted(r[0] for r in terms.select(size).distinct().collect() if r[0] and r[0] > 0)
    grams = F.flatten(F.array(*[grams_of(n) for n in lengths] or [F.array().cast("array<string>")]))
    exploded = tokens.select(key, F.explode(F.array_distinct(grams)).alias("_gram"))
    dictionary = terms.withColumn(
        "_gram", F.array_join(F.regexp_extract_all(F.lower("term"), F.lit(r"(?U)(\w+)"), 1), " ")
    )
    return exploded.join(dictionary, "_gram").drop("_gram")


__all__ = ["RuleSet", "Tag", "apply_origin", "match_terms_by_join", "rule_match", "term_pattern"]

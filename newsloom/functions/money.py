"""Amounts, figures, currencies and hedging found in text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fv


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """Constant map lookup; an unknown key is null."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(table, key)


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def amounts(body: Column) -> Column:
    """Array of currency amounts in reading order: span, currency, amount, unit, ord."""
    text = F.coalesce(body, F.lit(""))
    groups = [F.regexp_extract_all(text, F.lit(fv.CLAIM_AMOUNT), i) for i in range(4)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ["span", "cur", "num", "unit"])])

    def claim(row, i):
        unit = row["unit"]
        return F.struct(
            F.trim(row["span"]).alias("span"),
            lookup(fv.CLAIM_CURRENCY, F.upper(row["cur"])).alias("currency"),
            _number(row["num"]).alias("amount"),
            F.when(unit == "", F.lit("plain")).otherwise(lookup(fv.CLAIM_UNIT, F.lower(unit))).alias("unit"),
            i.alias("ord"),
        )

    named = F.transform(
        zipped,
        lambda z: F.struct(
            z["span"].alias("span"), z["cur"].alias("cur"), z["num"].alias("num"), z["unit"].alias("unit")
        ),
    )
    return F.filter(F.transform(named, claim), lambda c: c["currency"].isNotNull() & c["amount"].isNotNull())


def largest_usd_millions(text: Column) -> Column:
    """Largest dollar amount in millions, 0.0 when there is none.  Texts without a dollar sign never reach the regular expression."""
    body = F.coalesce(text, F.lit(""))
    nums = F.regexp_extract_all(body, F.lit(fv.USD_AMOUNT), 1)
    units = F.regexp_extract_all(body, F.lit(fv.USD_AMOUNT), 2)
    scaled = F.zip_with(
        nums,
        units,
        lambda n, u: _number(n) * F.when(F.lower(u).isin(fv.USD_AMOUNT_BILLION), 1000.0).otherwise(1.0),
    )
    return F.when(body.contains("$"), F.greatest(F.lit(0.0), F.coalesce(F.array_max(scaled), F.lit(0.0)))).otherwise(F.lit(0.0))


def numeric_facts(text: Column) -> Column:
    """Distinct (kind, value) facts, normalised so English and Chinese scales compare as equal."""
    body = F.coalesce(text, F.lit(""))
    nums = F.regexp_extract_all(body, F.lit(fv.FACT_NUMBER), 1)
    units = F.regexp_extract_all(body, F.lit(fv.FACT_NUMBER), 2)

    def fact(n, u):
        unit = F.lower(u)
        scale = lookup(fv.FACT_SCALES, unit)
        kind = F.when(unit.isin(fv.FACT_PERCENT), "percent").when(scale.isNotNull(), "amount").otherwise("plain")
        value = F.round(_number(n) * F.coalesce(scale, F.lit(1.0)), 6)
        return F.struct(kind.alias("kind"), value.alias("value"))

    facts = F.filter(F.zip_with(nums, units, fact), lambda f: f["value"].isNotNull())
    return F.array_sort(F.array_distinct(facts))


def currencies(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array(*[F.when(lowered.contains(k), v) for k, v in fv.DRAFT_CURRENCIES.items()])
    return F.array_sort(F.array_distinct(F.filter(hits, lambda c: c.isNotNull())))


def hedged(text: Column, markers: Iterable[str]) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for marker in markers:
        hit = hit | lowered.contains(marker)
    return hit

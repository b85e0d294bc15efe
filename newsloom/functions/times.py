"""Instants, calendar days and precision-aware dates.  Session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fv

_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:\d{2}|Z)$"


def instant(text: Column) -> Column:
    """Timestamp of an ISO string that carries an offset; a naive or broken one is null."""
    return F.when(text.rlike(_OFFSET), F.try_to_timestamp(text))


def micros(ts: Column | str) -> Column:
    """Epoch microseconds; a zone-less timestamp counts as UTC (the session zone)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def hkt_date(ts: Column) -> Column:
    """Hong Kong calendar day of an instant (fixed +08:00)."""
    return F.to_date(F.from_utc_timestamp(ts, fv.HKT_ZONE))


def stamp(published_at: Column, day: Column) -> Column:
    """The published instant as written, else the start of the card's Hong Kong day."""
    midnight = F.concat(day.cast("string"), F.lit("T00:00:00+08:00"))
    return F.when(instant(published_at).isNotNull(), published_at).otherwise(midnight)


def corrected_stamp(corrected: Column) -> Column:
    return F.when(corrected.contains("T"), corrected).otherwise(F.concat(corrected, F.lit("T00:00:00+08:00")))


def publication_date(published_at: Column, precision: Column) -> Column:
    """Calendar date only where the source established a day; month and unknown stay null."""
    value = F.when(published_at != "", published_at)
    return F.when(precision == "datetime", F.left(value, F.lit(10))).when(precision == "date", value)


def calendar_date(published_at: Column) -> Column:
    day = F.left(published_at, F.lit(10))
    return F.when(day.rlike(fv.ISO_DATE), day)


def rfc822(text: Column) -> Column:
    """Feed dates: the weekday is dropped, named zones and numeric offsets are both accepted."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    named = F.try_to_timestamp(F.regexp_replace(bare, r"\b(UT|Z)$", "GMT"), F.lit("d MMM yyyy HH:mm:ss z"))
    offset = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    naive = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))
    return F.coalesce(offset, named, naive)


def fresh(published: Column, now: Column, lookback_days: int = fv.LOOKBACK_DAYS) -> Column:
    """Inside the look-back window and not more than an hour ahead of the refresh."""
    oldest = now - F.make_dt_interval(F.lit(lookback_days))
    newest = now + F.make_dt_interval(F.lit(0), F.lit(fv.FUTURE_SLACK_HOURS))
    return published.between(oldest, newest)

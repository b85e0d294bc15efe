"""Stable ids, canonical URLs, digests and host tests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed_values as fv
from newsloom.functions.text import BLANKS, clean_text, normalize_body


def sha256_12(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def card_id(url: Column) -> Column:
    """Twelve hex digits of the trimmed, fragmentless, unslashed, lower-case URL."""
    bare = F.substring_index(F.trim(url), "#", 1)
    return sha256_12(F.lower(F.regexp_replace(bare, "/+$", "")))


def revision_id(parent_id: Column, fingerprint: Column) -> Column:
    return sha256_12(F.concat(parent_id, fingerprint))


def uuid5_url(url: Column) -> Column:
    """RFC 4122 version-5 UUID in the URL namespace, from built-in SHA-1 only."""
    space = F.unhex(F.lit(fv.UUID5_URL_NAMESPACE_HEX))
    h = F.sha1(F.concat(space, F.encode(url, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


_URL = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(#.+)?#?")
_BREAKS = str.maketrans("", "", "\t\r\n")


def _canonical(urls: pd.Series, unwanted: re.Pattern, host_case: bool, with_fragment: bool) -> pd.Series:
    """Split every URL by one pattern, keep the wanted parameters in one spelling of their escapes, join again."""

    def one(url: str) -> str:
        scheme, host, path, query, fragment = _URL.fullmatch(url.translate(_BREAKS).strip(" ")).groups("")
        halves = [piece.partition("=")[::2] for piece in query.split("&") if piece]
        plain = [(unquote_plus(k), unquote_plus(v)) for k, v in halves]
        kept = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in plain if not unwanted.fullmatch(k.lower()))
        host = host.lower() if host_case else host
        return "".join([f"{scheme.lower()}:" if scheme else "", host, path, f"?{kept}" if kept else "", fragment if with_fragment else ""])

    return urls.map(one, na_action="ignore")


def _any_of(names: Iterable[str], prefix: str | None = None) -> re.Pattern:
    choices = [re.escape(n) for n in sorted(names)] + ([re.escape(prefix) + ".*"] if prefix else [])
    return re.compile("|".join(choices), re.S)


@F.pandas_udf(T.StringType())
def event_url(urls: pd.Series) -> pd.Series:
    """Event identity: campaign parameters and fragment dropped, scheme and host lower-cased."""
    return _canonical(urls, _any_of(fv.EVENT_URL_DROPPED, fv.EVENT_URL_DROPPED_PREFIX), True, False)


@F.pandas_udf(T.StringType())
def evidence_url(urls: pd.Series) -> pd.Series:
    """Evidence identity: listed tracking parameters dropped, fragment and case kept."""
    return _canonical(urls, _any_of(fv.TRACKING_PARAMETERS), False, True)


def event_url_native(url: Column) -> Column:
    """Same rule with built-ins only, for URLs whose query needs no percent re-encoding."""
    bare = F.substring_index(url, "#", 1)
    base = F.substring_index(bare, "?", 1)
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise(F.lit(""))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~key(p).startswith(fv.EVENT_URL_DROPPED_PREFIX) & ~key(p).isin(fv.EVENT_URL_DROPPED),
    )
    head = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.substring(base, F.length(head) + 1, F.length(base))
    tail = F.array_join(F.transform(kept, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.concat(F.lower(head), path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))


def source_fingerprint(title: Column, feed_text: Column) -> Column:
    """Digest of the feed's own title and text; page retrieval never makes an item look revised."""
    return json_array_digest(clean_text(title), clean_text(feed_text))


@F.pandas_udf(T.StringType())
def json_array_digest(first: pd.Series, second: pd.Series) -> pd.Series:
    def one(a, b):
        return hashlib.sha256(json.dumps([a, b], ensure_ascii=False).encode()).hexdigest()

    return pd.Series([one(a, b) for a, b in zip(first, second)], index=first.index, dtype=object)


@F.pandas_udf(T.StringType())
def _canonical_json_digest(rows: pd.Series) -> pd.Series:
    def one(raw):
        value = json.loads(raw)
        return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    return rows.map(one, na_action="ignore")


def canonical_hash(row: Column) -> Column:
    """SHA-256 of the row's JSON with sorted keys.  Absent optional fields are absent, not null.

    Pass a JSON string column when the source document itself is at hand, else a struct.
    """
    return _canonical_json_digest(F.to_json(row))


def canonical_hash_of_json(raw: Column) -> Column:
    return _canonical_json_digest(raw)


def evidence_digest(text: Column, blanks: str = BLANKS) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(normalize_body(text, blanks), 256))


# --- hosts -----------------------------------------------------------------------------------
def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def host_is(host_col: Column, domains: Iterable[str]) -> Column:
    """Equal to a domain or below it at a dot; a bare suffix never counts."""
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (host_col == domain) | host_col.endswith("." + domain)
    return hit


def host_in(url: Column, domains: Iterable[str] | Column) -> Column:
    if isinstance(domains, Column):
        h = host(url)
        return F.exists(domains, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
    return host_is(host(url), domains)


def normalize_cik(value: Column) -> Column:
    """Zero-padded ten digits from the trailing number, null when there is none."""
    digits = F.regexp_extract(F.trim(value), r"(\d+)\s*$", 1)
    return F.when(digits != "", F.when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0")))

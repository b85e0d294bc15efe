"""Text normalisation, whole-word terms, tokenizers and filler removal."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed_values as fv

_ASCII_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"<[^>]+>")
_DASHES = str.maketrans(fv.TYPOGRAPHY)


# Everything Unicode calls white space, as one trim set.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Collapse every run of Unicode whitespace to one space and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# --- term matching ---------------------------------------------------------------------------
def _quoted(term: str) -> str:
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def _case_sensitive(term: str) -> bool:
    return re.fullmatch(r"[A-Z0-9]+", term) is not None


def term_pattern(terms: Iterable[str]) -> str:
    """One whole-word alternation: upper-case codes keep their case, all other terms ignore it.

    ``(?U)`` makes the word boundary Unicode-aware, so a code glued to an accented letter is not a hit.
    """
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    exact = [_quoted(t) for t in ordered if _case_sensitive(t)]
    loose = [_quoted(t) for t in ordered if not _case_sensitive(t)]
    parts = []
    if exact:
        parts.append("(?:" + "|".join(exact) + ")")
    if loose:
        parts.append("(?iu:" + "|".join(loose) + ")")
    if not parts:
        return r"(?!)"
    return r"(?U)(?<!\w)(?:" + "|".join(parts) + r")(?!\w)"


def fold(text: Column) -> Column:
    """Lower case under which every case-insensitive match of an ASCII term is a plain substring.

    Only texts with one of the letters that ``lower`` leaves outside ASCII are translated, as that takes them apart.
    """
    odd = "İıſ\u212a"
    return F.lower(F.when(contains_any(text, odd), F.translate(text, odd, "iisk")).otherwise(text))


def _maybe(text: Column, folded: Column, terms: Iterable[str], test: Column) -> Column:
    """Run a regular expression only on texts that contain one of its terms at all."""
    seen = F.lit(False)
    for term in sorted(set(terms), key=len):
        if not term.isascii():
            return test
        seen = seen | (text.contains(term) if _case_sensitive(term) else folded.contains(term.lower()))
    return seen & test


def has_term(text: Column, terms: Iterable[str], folded: Column | None = None) -> Column:
    """Whole-word hit; with ``folded`` (see :func:`fold`) most texts never reach the regular expression."""
    terms = list(terms)
    test = text.rlike(term_pattern(terms))
    return test if folded is None else _maybe(text, folded, terms, test)


def phrase_pattern(phrases: Iterable[str]) -> str:
    """Whole-word, always case-insensitive (event phrases, entity names)."""
    ordered = sorted(set(phrases), key=lambda t: (-len(t), t))
    return r"(?iuU)(?<!\w)(?:" + "|".join(_quoted(p) for p in ordered) + r")(?!\w)"


def has_phrase(text: Column, phrases: Iterable[str], folded: Column | None = None) -> Column:
    phrases = list(phrases)
    test = text.rlike(phrase_pattern(phrases))
    if folded is None or not all(p.isascii() for p in phrases):
        return test
    return contains_any(folded, sorted({p.lower() for p in phrases}, key=len)) & test


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


# --- cleaning --------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def clean_html(values: pd.Series) -> pd.Series:
    """Unescape, drop tags, collapse blanks, unescape again (entities need the full HTML table)."""

    def one(value):
        stripped = _TAG.sub(" ", html.unescape(value or ""))
        return _ASCII_SPACE.sub(" ", html.unescape(stripped)).strip()

    return values.map(one)


def clean_text(text: Column) -> Column:
    """Replacement characters become apostrophes, blanks collapse; the whole text."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), "�+", "'"))


def display_text(text: Column, cap: int = fv.TEXT_CAP) -> Column:
    """The first characters of the cleaned text, for showing only: identity and digests take the whole."""
    return F.left(clean_text(text), F.lit(cap))


def _nfkc_title(value):
    if value is None:
        return None
    folded = unicodedata.normalize("NFKC", value).casefold().translate(_DASHES)
    return _ASCII_SPACE.sub(" ", folded).strip()


@F.pandas_udf(T.StringType())
def normalize_title(values: pd.Series) -> pd.Series:
    """NFKC + casefold + plain quotes and dashes: Spark has no built-in NFKC."""
    return values.map(_nfkc_title, na_action="ignore")


def plain_quote_text(value: str) -> str:
    """Quote matching ignores typography and spacing only, never case or wording."""
    normal = unicodedata.normalize("NFKC", value).translate(_DASHES)
    return _ASCII_SPACE.sub(" ", normal).strip()


@F.pandas_udf(T.StringType())
def plain_text(values: pd.Series) -> pd.Series:
    return values.map(plain_quote_text, na_action="ignore")


def drop_publisher(title: Column) -> Column:
    return F.regexp_replace(title, r"(?U)\s[-|–]\s[^-|–]{1,40}$", "")


def title_key(title: Column) -> Column:
    """Headline identity across aggregators, without a trailing publisher name."""
    return normalize_title(drop_publisher(title))


def normalize_party(name: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]+", " ")
    return squeeze(spaced)


def normalize_body(text: Column, blanks: str = BLANKS) -> Column:
    """Drop blanks before line ends and runs of empty lines; the digest follows words, not wrapping.

    ``blanks`` is what is stripped from both ends.
    """
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(blanks))
    return F.regexp_replace(F.regexp_replace(body, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def normalize_form(label: Column) -> Column:
    """One spelling per form: upper case, single blanks, ``SCHEDULE x`` written as ``SC x``."""
    return F.regexp_replace(squeeze(F.upper(label)), r"^SCHEDULE ", "SC ")


def in_form_scope(label: Column, forms: Iterable[str]) -> Column:
    included = sorted({re.sub(r"^SCHEDULE ", "SC ", " ".join(f.upper().split())) for f in forms})
    return normalize_form(label).isin(included)


# --- tokenizers ------------------------------------------------------------------------------
def _tokens(text: Column, pattern: str, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)
    return F.filter(words, lambda w: ~w.isin(stop))


def headline_words(title: Column) -> Column:
    """Ordered content words of a headline; the first one is the lead word."""
    return _tokens(title, "[a-z0-9]+", fv.HEADLINE_STOPWORDS)


def search_words(title: Column) -> Column:
    words = _tokens(title, fv.SEARCH_WORD_PATTERN, fv.SEARCH_STOPWORDS)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def longest_words(title: Column, n: int = 5) -> Column:
    """The n longest distinct content words; equal lengths are ordered by the word itself."""
    keyed = F.transform(search_words(title), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["w"])


# --- filler removal --------------------------------------------------------------------------
def strip_absence(text: Column, lang: str = "en") -> Column:
    """Drop sentences claiming that an unread article gives no details; never return empty text."""
    splitter, pattern, glue = (
        (fv.SENTENCE_SPLIT_ZH, fv.SUMMARY_ABSENCE_ZH, "")
        if lang == "zh"
        else (fv.SENTENCE_SPLIT_EN, fv.SUMMARY_ABSENCE_EN, " ")
    )
    whole = F.coalesce(text, F.lit(""))
    kept = F.filter(
        F.split(whole, "(?U)" + splitter),
        lambda s: (F.length(squeeze(s)) > 0) & ~s.rlike("(?U)" + pattern),
    )
    trimmed = strip(F.array_join(kept, glue))
    fallback = strip(whole)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(fallback)


def bilingual(value: Column, lang: str) -> Column:
    chosen = value[lang]
    return F.coalesce(F.when(chosen != "", chosen), value["en"], F.lit(""))

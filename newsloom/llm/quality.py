"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Defined results: a null or empty text has no words, fails the base rule and is not kept; every input row gives
one output row, repeated ids included; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import space_words

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Lines a text must have before its repeated lines are judged; a passage that a short text holds twice is no sign of boilerplate.
LEAST_LINES = 6
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = (
    "the be to of and that have with in is it for on was as by at this are an from or "
    "de la le les et des en un une que qui pour dans sur par au avec "
    "der die und das den von zu mit ist im des ein eine für auf nicht sich als auch dem "
    "el los las del y por con para se su lo"
).split()


class Rule(NamedTuple):
    """A metric must lie inside [low, high]; null bounds are open."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: Ratios are of words unless the metric says otherwise.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "mean_word_length", 2.5, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("shouting", "exclamation_ratio", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.015, None),
    Rule("duplicate_lines", "dup_line_char_ratio", None, 0.3),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
)

_LONGS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars", "n_repeat_words", "n_stop_words", "n_exclamations", "n_ellipsis_lines", "n_bullet_lines")


def repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs at least twice in the same text.

    Windows are compared by a 64-bit hash.  Texts without a repeated window stop after one hash-set pass.
    """

    def from_windows(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def from_order(o: Column) -> Column:
            last = F.size(o) - 1
            twice = F.filter(
                F.sequence(F.lit(0), last),
                lambda j: ((j > 0) & (o[F.greatest(j - 1, F.lit(0))]["h"] == o[j]["h"])) | ((j < last) & (o[F.least(j + 1, last)]["h"] == o[j]["h"])),
            )
            places = F.array_sort(F.transform(twice, lambda j: o[j]["i"]))
            covered = F.aggregate(
                places,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
            )
            return covered["n"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.element_at(F.transform(F.array(order), from_order), 1))

    def from_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.element_at(F.transform(F.array(hashes), from_windows), 1)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.element_at(F.transform(F.array(words), from_words), 1))


def _lines(body: Column) -> Column:
    return F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _counts(body: Column, words: Column, lines: Column) -> list[Column]:
    stop = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    chars = lambda x: F.char_length(F.concat_ws("", x))
    counts = {
        "n_words": F.size(words),
        "word_chars": chars(words),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "line_chars": chars(lines),
        "dup_line_chars": chars(lines) - chars(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))),
        "n_exclamations": F.regexp_count(body, F.lit("!+")),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•·]"))),
    }
    return [counts[n].cast("long").alias(n) for n in _LONGS]


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts of every row; columns named in ``keep`` come along, and only those."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut_up = docs.select(*[F.col(c) for c in keep], body.alias("_body"), space_words(body).alias("_w"), _lines(body).alias("_l"))
    return cut_up.select(*[F.col(c) for c in keep], *_counts(F.col("_body"), F.col("_w"), F.col("_l")))


def _metrics(of: Callable[[str], Column]) -> dict[str, Column]:
    per_word = lambda c: of(c) / F.greatest(of("n_words"), F.lit(1))
    per_line = lambda c: of(c) / F.greatest(of("n_lines"), F.lit(1))
    return {
        "mean_word_length": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "exclamation_ratio": per_word("n_exclamations"),
        "stop_word_ratio": per_word("n_stop_words"),
        "dup_line_char_ratio": F.when(of("n_lines") >= LEAST_LINES, of("dup_line_chars") / F.greatest(of("line_chars"), F.lit(1))).otherwise(0.0),
        "ellipsis_line_ratio": per_line("n_ellipsis_lines"),
        "bullet_line_ratio": per_line("n_bullet_lines"),
    }


def _verdict(of: Callable[[str], Column], rules: Sequence[Rule], min_words: int, repeat_percent: int) -> tuple[Column, Column, Column]:
    """(base failed, names of broken rules, kept) of counts that ``of`` looks up by name."""
    metrics = _metrics(of)

    def broken(rule: Rule) -> Column:
        value, bad = metrics[rule.metric], F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        return F.when(bad, F.lit(rule.name))

    base = (of("n_words") < min_words) | (100 * of("n_repeat_words") > repeat_percent * of("n_words"))
    failed = F.array_compact(F.array(*[broken(r) for r in rules])) if rules else F.array().cast("array<string>")
    return base, failed, ~base & (F.size(failed) == 0)


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``."""
    base, failed, kept = _verdict(F.col, rules, min_words, repeat_percent)
    return measured.select("*", base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"), kept.alias("kept"))


def quality(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: its counts, what it fails and the verdict."""
    return judge(measure(docs, text, keep), rules)


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass, with all their own columns unchanged.

    The condition is one expression in which words, lines and counts are bound once; a filter over columns would be pushed
    below the projection and repeat every count at each place that reads it.
    """
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    body = F.coalesce(F.col(text), F.lit(""))

    def from_parts(p: Column) -> Column:
        return bound(F.struct(*_counts(p["b"], p["w"], p["l"])), lambda m: _verdict(lambda n: m[n], rules, MIN_WORDS, REPEAT_PERCENT)[2])

    return docs.filter(bound(F.struct(body.alias("b"), space_words(body).alias("w"), _lines(body).alias("l")), from_parts))


_SQL_STOP = ", ".join(f"'{v}'" for v in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
_SQL_METRIC = {
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "exclamation_ratio": "n_exclamations / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    "dup_line_char_ratio": f"CASE WHEN n_lines >= {LEAST_LINES} THEN dup_line_chars / greatest(line_chars, 1) ELSE 0 END",
    "ellipsis_line_ratio": "n_ellipsis_lines / greatest(n_lines, 1)",
    "bullet_line_ratio": "n_bullet_lines / greatest(n_lines, 1)",
}
_SQL_BROKEN = ", ".join(
    f"CASE WHEN {' OR '.join(f'{_SQL_METRIC[r.metric]} {sign} {bound}' for sign, bound in (('<', r.low), ('>', r.high)) if bound is not None)} THEN '{r.name}' END" for r in RULES
)

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w, list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM p),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u),
x AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(length(array_to_string(l, '')) AS BIGINT) AS line_chars, CAST(length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), '')) AS BIGINT) AS dup_line_chars,
    CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda y: y IN ({_SQL_STOP}))) AS BIGINT) AS n_stop_words,
    CAST(len(regexp_extract_all(t, '!+')) AS BIGINT) AS n_exclamations,
    CAST(len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|…)\s*$'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(l, lambda y: regexp_matches(y, '^\s*[-*•·]'))) AS BIGINT) AS n_bullet_lines
  FROM d LEFT JOIN x ON x.doc_id = d.doc_id),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
  list_filter([{_SQL_BROKEN}], lambda y: y IS NOT NULL) AS f FROM m)
SELECT * EXCLUDE (f), array_to_string(f, ',') AS failed_rules, NOT base_failed AND len(f) = 0 AS kept FROM v
"""

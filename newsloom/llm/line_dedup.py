"""Exact removal of repeated lines, sentences of lines, or paragraphs across and inside documents.

A unit is a line, or with ``sentences`` a piece of a line: a blank after one of ``.!?`` ends a piece too.  Its digest is taken
over the normalised text (A-Z lowered, white-space runs to one blank, trimmed).  The earliest occurrence by (doc_id, unit
number) stays, every later one goes, and all offsets refer to the original text.  Units of fewer than ``min_words`` words
are not judged: short sentences recur by chance.

Defined results: null and empty texts have one blank unit; units that are not judged are never counted or removed; rows that share
id and text count as one document and get equal results; rows that share only the id are ranked by the id alone, so
equal units at the same place of two such rows both stay; null ids rank last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, cut

_UPPER = {c: c + 32 for c in range(65, 91)}
_BLANK = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}
_FOLD = _UPPER | _BLANK
_ENDS = re.compile(r"([.!?])[\x20\x09\x0B-\x0D]")
#: Least number of words of a sentence unit in the registered query.
SENTENCE_WORDS = 8
#: A digest's occurrences meet its first place in so many tasks; larger ones are split further by the skew-join rule.
SALTS = 8
_UNITS = "doc_id long, row_hash long, unit int, start long, stop long, digest binary"


def normalised(unit: str) -> str:
    return " ".join(x for x in unit.translate(_FOLD).split(" ") if x)


def pieces(text: str, separator: str = "\n", sentences: bool = False) -> Iterator[tuple[int, int]]:
    """[start, stop) of every unit.  A sentence end is laid over as a separator of one character, so places stay."""
    shadow = _ENDS.sub("\\1\n", text) if sentences else text
    at = 0
    for unit in shadow.split("\n" if sentences else separator):
        yield at, at + len(unit)
        at += len(unit) + (1 if sentences else len(separator))


def _units_of(separator: str, sentences: bool, min_words: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, hashes, texts = (batch.column(i).to_pylist() for i in range(3))
        out: list[list] = [[] for _ in range(6)]
        for doc_id, row_hash, text in zip(ids, hashes, texts, strict=True):
            body = text or ""
            for n, (start, stop) in enumerate(pieces(body, separator, sentences)):
                plain = normalised(body[start:stop])
                if plain and plain.count(" ") + 1 >= min_words:
                    digest = hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for column, value in zip(out, (doc_id, row_hash, n, start, stop, digest), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = ("doc_id", "row_hash", "unit", "start", "stop", "digest")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=list(names))

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row_hash"), F.col(text).alias("text"))


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = "\n", sentences: bool = False, min_words: int = 1) -> DataFrame:
    """Every unit that is judged: doc_id, row_hash (of the text), unit number, [start, stop) in characters, digest."""
    return _keyed(docs, doc_id, text).mapInArrow(arrow_rows(_units_of(separator, sentences, min_words)), _UNITS)


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = "\n", sentences: bool = False, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(units, removed): all units, and those of which an earlier occurrence exists.

    First places come from a partial aggregate per digest; only digests that occur twice are joined back, and the occurrences
    of each are dealt over SALTS tasks that all hold its first place.
    """
    all_units = cut(units(docs, doc_id, text, separator, sentences, min_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("unit").alias("u"))
    first = all_units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter("first < last").select("digest", "first")
    salted = all_units.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_hash", "unit"), F.lit(SALTS)).cast("int"))
    everywhere = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    removed = salted.join(everywhere, ["digest", "salt"]).filter(rank > F.col("first")).select(*all_units.columns)
    return all_units, removed


def by_document(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = "\n", sentences: bool = False, min_words: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, removed_chars, removed_spans ("start-stop,...")."""
    all_units, removed = repeated_units(docs, doc_id, text, separator, sentences, min_words)
    counts = all_units.groupBy("doc_id", "row_hash").agg(F.count_distinct("unit").alias("n_units"))
    gone = _gone(removed).select(
        F.col("doc_id").alias("_d"),
        F.col("row_hash").alias("_h"),
        F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias("removed_spans"),
    )
    rows = _keyed(docs, doc_id, text).select(F.col("doc_id").alias("id"), F.col("row_hash").alias("h"))
    found = counts.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_hash") == F.col("_h")), "left")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("row_hash")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(F.col("id").alias("doc_id"), zero("n_units"), zero("n_removed"), zero("removed_chars"), F.coalesce("removed_spans", F.lit("")).alias("removed_spans"))


def _gone(removed: DataFrame) -> DataFrame:
    """Removed spans per document; a list holds at most the lines of one text."""
    return removed.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def _cut_out(body: str | None, gone_starts, separator: str, sentences: bool) -> str | None:
    """The units that stay, each but the first behind what stood between it and its predecessor."""
    if body is None or gone_starts is None or not len(gone_starts):
        return body
    drop, kept, before = set(gone_starts), [], 0
    for start, stop in pieces(body, separator, sentences):
        if start not in drop or start == stop:
            kept.append(body[before if kept else start : stop])
        before = stop
    return "".join(kept)


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = "\n", sentences: bool = False, min_words: int = 1) -> DataFrame:
    """The documents, columns unchanged, with repeated units cut out of the text."""
    _, removed = repeated_units(docs, doc_id, text, separator, sentences, min_words)
    gone = _gone(removed).select(F.col("doc_id").alias("_gone_id"), F.col("row_hash").alias("_gone_hash"), F.transform("spans", lambda s: s["start"]).alias("_gone_starts"))
    found = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(F.col(text)) == F.col("_gone_hash")), "left")

    @F.pandas_udf("string")
    def without(bodies: pd.Series, gone_starts: pd.Series) -> pd.Series:
        return pd.Series([_cut_out(b, s, separator, sentences) for b, s in zip(bodies, gone_starts, strict=True)])

    return found.select(*[without(F.col(text), F.col("_gone_starts")).alias(c) if c == text else F.col(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09\x0B-\x0D]', '\1' || chr(10), 'g'), chr(10)) AS pieces FROM documents),
u0 AS (SELECT doc_id, unnest(pieces) AS line, generate_subscripts(pieces, 1) - 1 AS unit FROM t),
u1 AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain FROM u0),
u AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY doc_id, unit) AS place FROM u1 WHERE plain <> '' AND length(plain) - length(replace(plain, ' ', '')) + 1 >= {SENTENCE_WORDS}),
g AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (place > 1) AS n_removed, coalesce(sum(length(line)) FILTER (place > 1), 0) AS removed_chars,
  coalesce(string_agg(start || '-' || (start + length(line)), ',' ORDER BY start) FILTER (place > 1), '') AS removed_spans FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars,
  coalesce(removed_spans, '') AS removed_spans FROM documents d LEFT JOIN g USING (doc_id)
"""

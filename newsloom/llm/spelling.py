"""Spelling variants: words one edit apart, the frequent form each rare word goes back to, and the root of its chain.

Letters are hashed to a few symbols.  Every distinct word generates the one-edit neighbourhood of its reduced word as 64-bit keys
(rolling hashes, so words of any length take one long each), the keys are joined with the reduced vocabulary, and what meets is
verified on the original strings in the same stage.  One edit of a word is at most one edit of its reduced word, so no pair is
missed; a hash collision only costs a verification.  "Near" has no direction, so of its full neighbourhood a word sends the half
that lies below it (itself, all deletions, and replacements by a lower symbol): an insertion is met as the deletion of the longer word, a
replacement by a higher symbol from the other side.  Every unordered pair thus meets exactly once.

Only distinct words are joined, counts are added up before the shuffle, and neighbours are summed up by partial aggregates, so
neither a frequent word nor a hot document gathers rows in one task.  Counts fall to a tenth with every step away from the
root, so chains are as long as the counts have digits; pointers double until none moves.

Defined results: null and empty texts and documents without words give nothing; repeated rows count once more each; a null id
reads as an empty text before the colon; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, ascii_lower
from newsloom.session import cut, cut_with, release

LETTERS = "A-Za-z\\u00C0-\\u00FF"
MIN_LENGTH, MIN_COUNT, RATIO, SYMBOLS = 7, 2, 10, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words whose neighbourhoods are laid out at a time; longer words than LONG go one by one, in slices of so many places.
_ROWS, LONG, _PLACES = 20_000, 64, 50_000


def symbols_of(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol (from 1) of every code point."""
    mixed = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(33)) % np.uint64(symbols) + np.uint64(1)


def neighbourhood(reduced: np.ndarray, symbols: int, below: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which of them count) of reduced words of one length, words x neighbours, no neighbour twice.

    The full neighbourhood of a word: itself, its deletions (one per run of a symbol), its replacements, its insertions (not
    next behind the same symbol, which would be the insertion before it).  ``below``: only those that do not lie above the
    word by (length, symbols); as one of two different neighbours always lies below the other, these are enough for a join.
    """
    n, length = reduced.shape
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(length + 1, _BASE))))
        before = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(reduced * powers[:length], 1, dtype=np.uint64)), 1)
        whole = before[:, -1:]
        # Behind[i]: what the symbols from place i on add when they stand one place further to the front.
        moved = reduced[:, 1:] * powers[: length - 1]
        behind = np.concatenate((np.cumsum(moved[:, ::-1], 1, dtype=np.uint64)[:, ::-1], np.zeros((n, 1), np.uint64)), 1)
        keys, counts = [whole], [np.ones((n, 1), bool)]
        if length:
            keys.append(before[:, :-1] + behind[:, :length])
            run_ends = np.ones((n, length), bool)
            run_ends[:, :-1] = reduced[:, 1:] != reduced[:, :-1]
            counts.append(run_ends)
        for symbol in np.arange(1, symbols + 1, dtype=np.uint64):
            keys.append(whole + (symbol - reduced) * powers[:length])
            counts.append(symbol < reduced if below else symbol != reduced)
            if not below:
                later = whole - before
                keys.append(before + symbol * powers[: length + 1] + later * _BASE)
                apart = np.ones((n, length + 1), bool)
                apart[:, 1:] = reduced != symbol
                counts.append(apart)
    return np.concatenate(keys, 1), np.concatenate(counts, 1)


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the words of one length, their symbols)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        yield own, symbols_of(codes[starts[own][:, None] + np.arange(length)], symbols)


def _keys(symbols: int, probe: bool):
    """(word, n) to (key, own, word, n): a row per neighbour below the word, or for the vocabulary side the word's own key."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            for places, reduced in _by_length(part.column(0).to_pylist(), symbols):
                keys, counts = neighbourhood(reduced, symbols, True) if probe else own_key(reduced)
                row, neighbour = np.nonzero(counts)
                rows = part.take(pa.array(places[row]))
                columns = [pa.array(keys[counts].view(np.int64)), pa.array(neighbour == 0), rows.column(0), rows.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "own", "word", "n"])

    return arrow_rows(run)


def _long_keys(symbols: int, probe: bool):
    """As :func:`_keys` for long words: (key, own, id); a row per neighbour must not carry the word itself."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def made(keys: np.ndarray, own: bool, word_id: int) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(n, own)), pa.array(np.full(n, word_id, np.int64))], names=["key", "own", "id"])

        for word, word_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reduced = next(_by_length([word], symbols))[1][0]
            length = len(reduced)
            with np.errstate(over="ignore"):
                powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(length - 1, _BASE))))
                before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(reduced * powers, dtype=np.uint64)))
                yield made(before[-1:], True, word_id)
                if not probe:
                    continue
                behind = np.concatenate((np.cumsum((reduced[1:] * powers[:-1])[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)))
                run_ends = np.append(reduced[1:] != reduced[:-1], True)
                for at in range(0, length, _PLACES):
                    own = slice(at, at + _PLACES)
                    yield made((before[:-1][own] + behind[own])[run_ends[own]], False, word_id)
                    for symbol in np.arange(1, symbols + 1, dtype=np.uint64):
                        yield made((before[-1] + (symbol - reduced[own]) * powers[own])[symbol < reduced[own]], False, word_id)

    return arrow_rows(run)


def own_key(reduced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the reduced words themselves, in the form of :func:`neighbourhood`."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(reduced.shape[1], _BASE))))
        whole = (reduced * powers[: reduced.shape[1]]).sum(1, dtype=np.uint64)[:, None]
    return whole, np.ones(whole.shape, bool)


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word) for every maximal run of letters of at least ``min_length``, A-Z lowered."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("run"))
    return rows.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), ascii_lower(F.col("run"))).otherwise(F.col("run")).alias("word"))


def with_slips(words: DataFrame, every: int = 31) -> DataFrame:
    """Words of a document as mistyped there: where crc32 of "id:word" is a multiple of ``every``, one letter is left out."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("word")).cast("binary"))
    place = F.pmod(h, F.char_length("word").cast("long")).cast("int")
    short = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.char_length("word")))
    return words.select("doc_id", F.when(h % every == 0, short).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the distinct words; each task counts its own before the shuffle."""
    long_enough = words.filter(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, b, n_a, n_b): every unordered pair of distinct words exactly one insertion, deletion or replacement apart, once."""
    spread = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vocab.select("word", "n", F.char_length("word").alias("l")).repartition(spread)  # a row becomes dozens
    return _near(rows.filter(F.col("l") <= LONG), symbols).unionByName(_near_long(rows.filter(F.col("l") >= LONG), symbols))


def _verified(met: DataFrame) -> DataFrame:
    # Words of one reduced form meet from both sides: the later one keeps the pair.
    once = F.when(F.col("own"), F.col("a") > F.col("b")).otherwise(F.col("a") != F.col("b"))
    apart = F.abs(F.char_length("a") - F.char_length("b"))
    return met.filter(once & (apart <= 1) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def _near(words: DataFrame, symbols: int) -> DataFrame:
    """Pairs of words of at most LONG code points; the rows carry the words."""
    schema = "key long, own boolean, word string, n long"
    low = words.select("word", "n").mapInArrow(_keys(symbols, True), schema).select("key", "own", F.col("word").alias("a"), F.col("n").alias("n_a"))
    all_words = words.select("word", "n").mapInArrow(_keys(symbols, False), schema).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    return _verified(low.join(all_words, "key"))


def _near_long(words: DataFrame, symbols: int) -> DataFrame:
    """Pairs whose longer word has more than LONG code points; hashes meet first, the words are joined to what met."""
    schema = "key long, own boolean, id long"
    named = words.select("word", "n", "l", F.xxhash64("word").alias("id"))
    low = named.filter(F.col("l") > LONG).select("word", "id").mapInArrow(_long_keys(symbols, True), schema).withColumnRenamed("id", "id_a")
    all_words = named.select("word", "id").mapInArrow(_long_keys(symbols, False), schema).select("key", F.col("id").alias("id_b"))
    met = low.join(all_words, "key").select("own", "id_a", "id_b").distinct()
    left = named.select(F.col("id").alias("id_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = named.select(F.col("id").alias("id_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    return _verified(met.join(left, "id_a").join(right, "id_b"))


def forms(vocab: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n (ties: the smallest), if at least ``ratio`` times as frequent."""
    pairs = near_pairs(vocab, symbols)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )
    both = pairs.select(F.inline(sides))
    best = F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other")))
    near = both.groupBy(F.col("word").alias("_word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocab.join(near, F.col("word") == F.col("_word"), "left")
    holds = F.col("best.m") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.other")).alias("form"), F.when(holds, F.col("best.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows without cycles: pointers double, a written table a round, until none moves."""
    current = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = current.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        following, seen = cut_with(moved, "roots", moved=F.sum(F.col("moved").cast("int")))
        release(current)
        current = following.select("word", "root")
        if not seen["moved"]:
            return current
        current._newsloom_path = following._newsloom_path


def variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """One row per word of (…, word) rows: word, form, root, n, n_near, form_n."""
    found = cut(forms(cut(vocabulary(words, min_length, min_count), "vocabulary"), ratio, symbols), "forms")
    ends = roots(found.filter("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    joined = found.join(ends, F.col("word") == F.col("_word"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`variants` of the documents' words with their slips."""
    return variants(with_slips(runs(docs)))


#: Near pairs by their common deletions; the crc32 is computed bit by bit from its polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM t WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, concat(doc_id, ':', run) AS s FROM r GROUP BY 1, 2),
e AS (SELECT run, n, hex(encode(s)) AS x FROM d),
h AS (SELECT run, n, xor(list_reduce([CAST(('0x' || x[2 * i + 1 : 2 * i + 2]) AS BIGINT) FOR i IN range(len(x) // 2)], lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM e, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS l FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, l, unnest(range(l)) AS i FROM v),
g AS (SELECT DISTINCT word, n, l, substr(word, 1, i) || substr(word, i + 2) AS s, i FROM x),
p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM g a JOIN v b ON a.s = b.word),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT a.word, b.word FROM g a JOIN g b ON a.s = b.s AND a.i = b.i AND a.l = b.l AND a.word <> b.word),
m AS (SELECT q.a AS word, count(*) AS n_near, max(v.n) AS top FROM q JOIN v ON v.word = q.b GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= 10 * v.n THEN (SELECT min(q.b) FROM q JOIN v u ON u.word = q.b WHERE q.a = v.word AND u.n = m.top) END AS form, CASE WHEN m.top >= 10 * v.n THEN m.top END AS form_n FROM v LEFT JOIN m USING (word)),
z AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.onward)
SELECT f.word, f.form, z.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN z ON z.word = f.word AND z.onward IS NULL
"""

"""Benchmark decontamination: an FM-index per shard of documents, searched for all test phrases at once.

A shard is a batch of documents.  Words that no test phrase has cannot be part of an occurrence, so the shard's text is
the runs of test words that are long enough, with a break between runs; its Burrows-Wheeler transform is held in a
wavelet matrix, phrases are searched backwards by two ranks a word, and places come from every 16th suffix position.
Documents are never shuffled.  Test items travel to the tasks in parts of bounded size.

Defined results: words are runs of ASCII letters and digits and all non-ASCII, A-Z lowered; a null text or item has none;
an item of fewer than ten words is one phrase; items without an id are searched but not listed; a repeated item id counts
once; every document row is judged on its own, repeated ids included; empty tables on either side give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.suffix_array import suffix_array
from newsloom.llm.text_arrays import Words, alnum_table, slices, span_hashes, utf8, words

WINDOW = 10
SAMPLE = 16
#: Bytes of items in one broadcast part.
PART_BYTES = 8 << 20
_BREAK, _FIRST = 1, 2  # symbol 0 ends the shard


class WaveletMatrix:
    """Ranks of any symbol before any place, a bit level at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros_like(place)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = ((symbol >> level) & 1).astype(bool)
            place = np.where(up, zeros + ones[place], place - ones[place])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return place - start


class FMIndex:
    """Backward search over integer symbols; the text must end with its only 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_array(text.astype(np.int32), symbols).astype(np.int64)
        self.last = text[order - 1].astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.tree = WaveletMatrix(self.last, max(1, int(symbols - 1).bit_length()))
        self.sampled = order % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases stand at the right end of their rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: walk towards the front until a sampled suffix."""
        steps = np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.places[self.slot[at[done]]] + steps[live[done]]
            live, at = live[~done], at[~done]
            symbol = self.last[at]
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps[live] += 1
        return out


@dataclass
class Phrases:
    """Test phrases of a part of the items, as symbols of the part's own vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = index + _FIRST
    symbols: np.ndarray  # phrases x window, right-aligned
    lengths: np.ndarray
    item: np.ndarray  # item of each (phrase, item) pair ...
    first: np.ndarray  # ... from first[phrase] on
    names: list[str | None]


def phrases_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases | None:
    """Distinct windows of the items, each with the items it comes from."""
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    w = words(data, offsets, alnum_table())
    code = span_hashes(w)
    vocabulary = np.unique(code)
    symbol = np.searchsorted(vocabulary, code) + _FIRST
    rows, owners = [], []
    for i in range(len(items)):
        own = symbol[w.first[i] : w.first[i + 1]]
        if not len(own):
            continue
        if len(own) < window:
            rows.append(np.concatenate((np.zeros(window - len(own), np.int64), own))[None])
        else:
            rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
        owners.append(np.full(len(rows[-1]), i))
    if not rows:
        return None
    distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack((which.ravel(), np.concatenate(owners)), 1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Phrases(vocabulary, distinct, np.count_nonzero(distinct, axis=1), pairs[:, 1], first, [None if i is None else str(i) for i, _ in items])


def occurrences(w: Words, code: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence of the part's phrases in a shard's words."""
    at = np.minimum(np.searchsorted(p.vocabulary, code), len(p.vocabulary) - 1)
    known = p.vocabulary[at] == code
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    head = known.copy()
    head[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(head)
    tail = known.copy()
    tail[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
    ends = np.flatnonzero(tail) + 1
    long = ends - starts >= p.lengths.min()
    starts, size = starts[long], (ends - starts)[long]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Every run with a break behind it, and the end of the shard.
    stop = np.cumsum(size + 1)
    word = np.arange(stop[-1]) - np.repeat(stop - size - 1, size + 1) + np.repeat(starts, size + 1)
    text = at[np.minimum(word, len(at) - 1)] + _FIRST
    text[stop - 1] = _BREAK
    text = np.append(text, 0)
    index = FMIndex(text, len(p.vocabulary) + _FIRST)
    low, high = index.search(p.symbols, p.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(low)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return word[index.locate(rows)], phrase


def _shard(batch: pa.RecordBatch, column: int, parts: list[Broadcast]) -> Iterator[tuple[int, Words, np.ndarray, list[set]]]:
    """Per slice of a batch: (first row, words, hit words, ids of the items found in each row)."""
    data, offsets = utf8(batch.column(column))
    for r0, r1 in slices(offsets, SHARD_BYTES):
        w = words(data, offsets[r0 : r1 + 1], alnum_table())
        code = span_hashes(w)
        edge = np.zeros(len(code) + 1, np.int64)
        items: list[set] = [set() for _ in range(r1 - r0)]
        for part in parts:
            p = part.value
            if not len(code):
                break
            at, phrase = occurrences(w, code, p)
            edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + p.lengths[phrase], minlength=len(edge))
            doc = np.searchsorted(w.first, at, "right") - 1
            for d, f in np.unique(np.stack((doc, phrase), 1), axis=0):
                items[d].update(p.names[i] for i in p.item[p.first[f] : p.first[f + 1]])
        yield r0, w, np.cumsum(edge)[:-1] > 0, items


SHARD_BYTES = 4 << 20
_ROW = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans string"


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _report(parts: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, w, hit, items in _shard(batch, 1, parts):
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                names = [sorted(x for x in s if x is not None) for s in items]
                spans = [""] * len(items)
                for d in np.flatnonzero(n_hit):
                    a, b = _runs(hit[w.first[d] : w.first[d + 1]])
                    spans[d] = ",".join(f"{x}-{y}" for x, y in zip(a, b, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(r0, len(items)),
                        pa.array(np.diff(w.first)),
                        pa.array(n_hit),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                        pa.array(n_hit > 0),
                        pa.array(spans, pa.string()),
                    ],
                    names=[x.split()[0] for x in _ROW.split(", ")],
                )

    return run


def _cleaner(column: int, parts: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for r0, w, hit, items in _shard(batch, column, parts):
                total = np.concatenate(([0], np.cumsum(hit)))
                for d in np.flatnonzero(total[w.first[1:]] > total[w.first[:-1]]):
                    a, b = _runs(hit[w.first[d] : w.first[d + 1]])
                    raw, base, at = w.data[w.base[d] : w.base[d + 1]].tobytes(), w.base[d], 0
                    kept = []
                    for x, y in zip(a + w.first[d], b + w.first[d], strict=True):
                        kept.append(raw[at : w.starts[x] - base])
                        at = int(w.ends[y - 1] - base)
                    texts[r0 + d] = b"".join([*kept, raw[at:]]).decode()
            columns = [pa.array(texts, batch.schema.field(i).type) if i == column else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def item_phrases(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> list[Broadcast]:
    """The items' phrases, broadcast in parts; a part's items have about ``part_bytes`` of text together."""
    pairs = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    size = pairs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-int(size) // part_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    made = (phrases_of([(r["id"], r["text"]) for r in pairs.filter(part == i).collect()], window) for i in range(n))
    return [items.sparkSession.sparkContext.broadcast(p) for p in made if p is not None]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found (count and digest), and hit spans as word ranges."""
    parts = item_phrases(items, item_id, item_text, window)
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pairs.mapInArrow(_report(parts), _ROW)


def remove_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, other columns unchanged, without the bytes from a hit span's first to its last word."""
    parts = item_phrases(items, item_id, item_text, window)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(_cleaner(docs.columns.index(text), parts), schema)


ORACLE_SQL = rf"""
WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < {WINDOW} THEN [w] ELSE [w[k:k + {WINDOW - 1}] FOR k IN range(1, len(w) - {WINDOW - 2})] END) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS n FROM p),
d AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM lower_docs, sizes),
h AS (SELECT d.doc_id, d.k, d.n, p.item_id FROM (SELECT doc_id, k, n, w[k:k + n - 1] AS g FROM d) d JOIN p ON p.g = d.g),
c AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM h), (SELECT unnest(range({WINDOW})) AS o) WHERE o < n GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id),
hits AS (SELECT DISTINCT doc_id, k + o - 1 AS j FROM (SELECT DISTINCT doc_id, k, n FROM h), (SELECT unnest(range({WINDOW})) AS o) WHERE o < n),
runs AS (SELECT doc_id, min(j) AS a, max(j) + 1 AS b FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS z FROM hits) GROUP BY doc_id, z),
spans AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS s FROM runs GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(s, '') AS hit_spans
FROM lower_docs l LEFT JOIN c USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

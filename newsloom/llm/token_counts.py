"""Token counts per section from one encoding of the whole document.

The document is encoded once; every token's span (from the byte lengths of the vocabulary) is joined to the sections
by position.  A token that crosses a boundary goes whole to one section by an explicit rule: ``start`` (the section of
its first byte, the default), ``end`` (of its last byte) or ``largest`` (of most of its bytes, the earlier on a tie).
So the counts of a document's sections always add up to its token count.

Defined results: sections are lines with their newline; a null or empty text is one empty section without tokens;
every input row is counted on its own, repeated ids included; text that spells a special token is ordinary text;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "largest")
_SCHEMA = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long"
_ROWS = 50_000


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the byte length of every token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(spans_end: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of every token, whether it crosses) for token ends and section ends, both ascending bytes."""
    starts = np.concatenate(([0], spans_end))[:-1]
    first = np.searchsorted(edges, starts, "right")
    last = np.searchsorted(edges, spans_end, "left")
    owner = {"start": first, "end": last}.get(rule)
    if owner is None:
        owner = first.copy()
        for i in np.flatnonzero(last > first):
            cuts = np.concatenate(([starts[i]], edges[first[i] : last[i]], [spans_end[i]]))
            owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return owner, last > first


def _counter(path: str, rule: str):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(path)
        out: list[list] = [[] for _ in range(6)]
        rows = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) if i else pa.array([v for part in c for v in part], t) for i, (c, t) in enumerate(zip(out, kinds, strict=True))], names=names)
            for c in out:
                c.clear()
            return made

        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            raw = np.frombuffer(text.encode(), np.uint8)
            edges = np.flatnonzero(raw == 10) + 1
            if len(edges) == 0 or edges[-1] != len(raw):
                edges = np.append(edges, len(raw))
            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[edges]
            ends = np.cumsum(lengths[np.array(encoding.encode_ordinary(text), np.int64)])
            owner, crossing = attribute(ends, edges, rule)
            n = len(edges)
            for column, values in zip(
                out,
                ([doc_id] * n, np.arange(n), np.concatenate(([0], chars[:-1])), chars, np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)),
                strict=True,
            ):
                column.append(values)
            rows += n
            if rows >= _ROWS:
                rows = 0
                yield flush()
        yield flush()

    return run


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """One row per section: doc_id, section (from 0), its character span, tokens given to it, crossing ones among them."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pairs.mapInArrow(arrow_rows(_counter(vocabulary, rule)), _SCHEMA)


def document_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals per id, from the sections."""
    return section_tokens(docs, doc_id, text, vocabulary).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_sections"))

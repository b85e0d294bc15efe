"""Vectorised word and shingle arithmetic on Arrow string columns, shared by the operators of this folder.

Everything works on the raw UTF-8 bytes of a slice of documents, so a call's memory is bounded by the
slice (`SLICE_BYTES`, or one document where a single one is longer) and not by the batch Spark hands over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@lru_cache(maxsize=None)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=2)
def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """First ``n`` powers of the base (or of its inverse); lengths are rounded up so calls share the table."""
    size = 1 << max(SLICE_BYTES.bit_length(), int(n).bit_length())
    return _powers_of(pow(_BASE, -1, 2**64) if inverse else _BASE, size)[:n]


def fold_table(lower: bool) -> np.ndarray:
    """Byte to byte: A-Z to a-z, everything else unchanged."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """True for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    keep = np.ones(256, bool)
    keep[[0x20, 9, 10, 11, 12, 13]] = False
    return keep


def alnum_table() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing)."""
    keep = np.ones(256, bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        keep[low : high + 1] = False
    return keep


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts are about ``limit`` bytes together; at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


@dataclass
class Words:
    """Words of a slice: byte spans in ``data`` and, per document, the range of its words."""

    data: np.ndarray
    base: np.ndarray  # byte offset of each document in data, plus the end
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, plus the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = True) -> Words:
    """Cut a slice of documents into words by a byte table; a word never crosses documents."""
    base = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    inside = keep[fold_table(lower)[data]] if lower else keep[data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[base] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return Words(data, base, starts, ends, np.searchsorted(starts, base))


def span_hashes(w: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, equal exactly for equal (lower-cased) bytes up to hash collisions."""
    n = len(w.data)
    letters = _letters()[fold_table(True)] if lower else _letters()
    total = np.zeros(n + 1, _U)
    np.cumsum(letters[w.data] * powers(n), out=total[1:])
    return mix((total[w.ends] - total[w.starts]) * powers(n + 1, inverse=True)[w.starts] + (w.ends - w.starts).astype(_U))


_WEIGHTS = [_U(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingle_sets(w: Words, hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(flat, bounds): the sorted distinct shingles of each document, one after another.

    A document with fewer than ``size`` words, but not none, has its whole word sequence as one shingle.
    """
    n = len(hashes)
    acc = np.zeros(max(0, n - size + 1), _U)
    for k in range(size):
        acc += hashes[k : n - size + 1 + k] * (_WEIGHTS[k % 5] + _U(2 * (k // 5)))
    acc = mix(acc + _U(size)) if len(acc) else acc
    out, bounds = [], np.zeros(len(w.first), np.int64)
    first = w.first
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            own = np.sort(acc[a : b - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
            bounds[d + 1] = len(own)
        elif b > a:
            whole = _U(0)
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    whole += hashes[a + k] * _WEIGHTS[k % 5]
            out.append(mix(np.array([whole ^ _U(0x5851F42D4C957F2D * int(b - a) % 2**64)])))
            bounds[d + 1] = 1
    return (np.concatenate(out) if out else np.empty(0, _U)), np.cumsum(bounds)

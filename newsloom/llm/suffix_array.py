"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The induction runs bucket by bucket over whole arrays: what a bucket's suffixes induce is split by first symbol with a
stable radix sort, so no Python code runs per suffix.  A run of one symbol takes one step per repetition.

The leftmost-smaller (LMS) substrings are named and their order is found on the reduced string, recursively: by
induction again while its alphabet is small against its length, else by doubling, since with nearly as many
buckets as symbols a bucket-wise induction would be a loop per symbol.
"""

from __future__ import annotations

import numpy as np

from newsloom.llm.text_arrays import mix, powers

#: Mean bucket size from which induction pays.
MEAN_BUCKET = 512


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the text is smaller than everything."""
    n = len(text)
    small = np.zeros(n, bool)
    if n < 2:
        return small
    flag = text[1:] != text[:-1]
    differs = np.flatnonzero(flag)
    rises = text[differs] < text[differs + 1]
    at = np.concatenate(([0], np.cumsum(flag)))  # next change of symbol; none: the run reaches the end
    inside = at < len(differs)
    small[inside] = rises[at[inside]]
    return small


class _Buckets:
    """Per symbol, pieces of suffixes in the order they arrived."""

    def __init__(self, symbols: int):
        self.pieces: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def add(self, suffixes: np.ndarray, heads: np.ndarray) -> None:
        order = np.argsort(heads, kind="stable")
        suffixes, heads = suffixes[order], heads[order]
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        start = 0
        for end in [*cuts.tolist(), len(heads)]:
            self.pieces[heads[start]].append(suffixes[start:end])
            start = end


def _induce(text: np.ndarray, small: np.ndarray, symbols: int, seeds: list[np.ndarray]) -> np.ndarray:
    """The order of all suffixes, given per symbol the seeds: LMS suffixes in their order."""
    n = len(text)
    large = _Buckets(symbols)
    done_large: list[np.ndarray] = []
    last = np.array([n - 1], np.int32)  # the last suffix is induced by the end of the text
    large.add(last, text[last])
    empty = np.empty(0, np.int32)

    def push(of: np.ndarray, into: _Buckets, symbol: int, want_small: bool) -> np.ndarray:
        """Predecessors of the wanted type go to their buckets; those of this very bucket come back."""
        before = of[of > 0] - 1
        before = before[small[before] == want_small]
        heads = text[before]
        same = heads == symbol
        own = before[same]
        if len(own) < len(before):
            other = ~same
            into.add(before[other], heads[other])
        return own

    for c in range(symbols):
        wave = np.concatenate(large.pieces[c]) if large.pieces[c] else empty
        rows = []
        while len(wave):
            rows.append(wave)
            wave = push(wave, large, c, False)
        done_large.append(np.concatenate(rows) if rows else empty)
        large.pieces[c] = []
        if len(seeds[c]):
            push(seeds[c], large, c, False)
    smaller = _Buckets(symbols)
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        # From the back: pieces arrive in falling order, as do the members of a piece.
        wave = np.concatenate(smaller.pieces[c]) if smaller.pieces[c] else empty
        rows = []
        while len(wave):
            rows.append(wave)
            wave = push(wave, smaller, c, True)
        smaller.pieces[c] = []
        falling = np.concatenate(rows) if rows else empty
        out += [falling[::-1], done_large[c]]
        if len(done_large[c]):
            push(done_large[c][::-1], smaller, c, True)
    return np.concatenate(out[::-1])


def _seeds(text: np.ndarray, ordered: np.ndarray, symbols: int) -> list[np.ndarray]:
    heads = text[ordered]
    order = np.argsort(heads, kind="stable")
    ends = np.cumsum(np.bincount(heads, minlength=symbols))
    return np.split(ordered[order], ends[:-1])


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order: equal substrings, equal names; order of names, order of substrings."""
    n = len(text)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(11)) * powers(n), out=total[1:])
    stop = np.append(lms[1:] + 1, n)
    code = mix((total[stop] - total[lms]) * powers(n + 1, inverse=True)[lms] + (stop - lms).astype(np.uint64))
    code[-1] ^= np.uint64(1)  # the last one ends with the text, as no other does
    place = np.empty(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    by_order = code[place[ordered]]
    fresh = np.concatenate(([0], np.cumsum(by_order[1:] != by_order[:-1])))
    names = np.empty(len(lms), np.int32)
    names[place[ordered]] = fresh
    return names, int(fresh[-1]) + 1


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    # A rank is the place of the first of its tied suffixes.
    sorted_rank = rank[order]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1])), np.arange(n), 0))
    rank[order] = start
    step = 1
    while True:
        placed = rank[order]
        tied = np.zeros(n, bool)
        equal = placed[1:] == placed[:-1]
        tied[1:] |= equal
        tied[:-1] |= equal
        at = np.flatnonzero(tied)
        if not len(at):
            return order.astype(np.int32)
        who = order[at]
        ahead = who + step
        key = rank[who] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        resort = np.argsort(key, kind="stable")
        order[at] = who[resort]
        key = key[resort]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        step *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of all suffixes of ``text`` (unsigned integers under ``symbols``) in lexicographic order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    if n < MEAN_BUCKET * symbols:
        return _doubling(text)
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        rough = _induce(text, small, symbols, _seeds(text, lms, symbols))
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = rough[is_lms[rough]]
        names, distinct = _names(text, lms, ordered)
        ordered = ordered if distinct == len(lms) else lms[suffix_array(names, distinct)]
    else:
        ordered = lms
    return _induce(text, small, symbols, _seeds(text, ordered, symbols))


def permuted_lcp(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of every suffix of bytes with the one before it in ``order``, in text order, exact up to ``cap``.

    Where a suffix and its neighbour have the same symbol before them, the value is one less than at the place before;
    only the others are compared, eight symbols at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n // 8 * 8 + 16, np.uint8)
    padded[:n] = text
    words = np.empty(len(padded) - 8, np.uint64)  # the eight symbols from each place on
    for shift in range(8):
        words[shift::8] = padded[shift : len(padded) - 8 + shift].view(np.uint64)
    place = np.arange(n)
    fresh = place % cap == 0  # so that no value is carried over more than cap places, and 2 cap symbols suffice
    inner = (place > 0) & (before > 0)
    fresh[~inner] = True
    fresh[inner] |= text[place[inner] - 1] != text[before[inner] - 1]
    live = np.flatnonzero(fresh & (before >= 0))
    length = np.zeros(n, np.int64)
    for at in range(0, 2 * cap, 8):
        a, b = live + at, before[live] + at
        room = n - np.maximum(a, b)
        fits = room > 0
        live, a, b, room = live[fits], a[fits], b[fits], room[fits]
        if not len(live):
            break
        differ = words[a] ^ words[b]
        lowest = differ & (~differ + np.uint64(1))
        same = (np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64)
        length[live] = at + np.minimum(same, room)
        live = live[same == 8]
    anchor = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.maximum(length[anchor] - (place - anchor), 0)

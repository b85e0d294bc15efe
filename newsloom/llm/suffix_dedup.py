"""Removal of 50-byte strings that an earlier document also holds, by suffix arrays over shards.

A byte goes if some 50-byte string over it also starts in a document with a smaller id.  All windows of 50 bytes are
judged, on the input, and never across documents.

How equal windows meet.  Each window names an anchor, the least hash of its 20-byte strings, so equal windows name
equal anchors, and runs of neighbouring windows with one anchor form a segment of 65 bytes on average.

1. Segments whose anchor lives in one document only are dropped (a test per anchor, by hash bucket).
2. The others are cut from the texts; inside a group of documents a segment that a smaller document of the group also
   has is settled at once, so every group sends a segment at most once, however many copies it holds.
3. Segments meet in shards by anchor.  A shard induces the suffix array of its distinct segments, takes permuted common
   prefixes, and every run of neighbours with 50 common bytes is one window: its smallest document keeps it.
4. Removed spans return to the texts.

Numbers of buckets, groups and shards follow the size of the texts, so a task's memory does not grow with the input.

Defined results: a null text is empty; a text under 50 bytes loses nothing; rows that share an id never remove from each
other; a null id ranks after all others; identical rows get equal results; an empty table gives no rows.  The cleaned
text drops bytes of characters that a window's edge has cut in two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut, pack_arrays, release, tidy, unpack_arrays
from newsloom.llm.suffix_array import permuted_lcp, suffix_array
from newsloom.llm.text_arrays import mix, powers, slices, utf8

LENGTH = 50
ANCHOR = 20
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
GROUP_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
_LONGEST_RUN = 256
_CODEC = "zstd"  # of what travels: texts of segments shrink further by it than by the shuffle's own compression
_SEPARATOR = 0xFF  # no byte of UTF-8
_LAST = np.iinfo(np.int64).max
_BLOB = "kind int, key long, blob binary"
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on, composed from powers of two."""
    done, covered, part, width = None, 0, mix(data.astype(_U) + _U(1)), 1
    while size:
        if size & 1:
            if done is None:
                done, covered = part, width
            else:
                n = min(len(done), len(part) - covered)
                done = done[:n] * _U(pow(_STEP, width, 2**64)) + part[covered : covered + n]
                covered += width
        size >>= 1
        if size:
            n = len(part) - width
            part = part[:n] * _U(pow(_STEP, width, 2**64)) + part[width:]
            width *= 2
    return mix(done)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, base: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in data, windows, anchor hash) of every segment of a slice of documents."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    least = _sliding_min(_grams(data, anchor), length - anchor + 1)
    n = len(least)
    edge = np.zeros(n + 1, bool)
    edge[base[base <= n]] = True
    whole = np.ones(n, bool)  # windows inside one document
    for b in base[1:-1]:
        whole[max(0, b - length + 1) : b] = False
    head = whole.copy()
    head[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | edge[1:n]
    starts = np.flatnonzero(head)
    if not len(starts):
        return starts, starts, starts, np.empty(0, _U)
    last = whole.copy()
    last[:-1] &= (least[1:] != least[:-1]) | ~whole[1:] | edge[1:n]
    windows = np.flatnonzero(last) + 1 - starts
    if windows.max() > _LONGEST_RUN:
        pieces = -(-windows // _LONGEST_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, windows = np.repeat(starts, pieces) + nth * _LONGEST_RUN, np.minimum(np.repeat(windows, pieces) - nth * _LONGEST_RUN, _LONGEST_RUN)
    return np.searchsorted(base, starts, "right") - 1, starts, windows, least[starts] >> _U(16)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first place of each run of equal keys) after a sort by the keys, the last one first."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(fresh)


def _long(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds, keys, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _split(key: np.ndarray, columns: dict[str, np.ndarray], kind: int) -> list[tuple[int, int, bytes]]:
    """One packed row per key value."""
    order, first = _runs(key)
    bounds = [*first.tolist(), len(order)]
    return [(kind, int(key[order[a]]), pack_arrays(_CODEC, **{n: c[order[a:b]] for n, c in columns.items()})) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _anchors(buckets: int):
    """Step 1, by some megabytes of documents (tag, text).

    Of an anchor that several of these documents have, one segment goes to the anchor's bucket, marked as settled,
    and the rest travel with any bucket: a very common passage is spread from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = _long(batch.column(0))
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                if columns := found(data, offsets[a : b + 1], tags[a:b]):
                    yield from _rows(_split(columns.pop("bucket"), columns, 0)).to_batches()

    def found(data: np.ndarray, offsets: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray] | None:
        parts = []
        for r0, r1 in slices(offsets):
            base = offsets[r0 : r1 + 1] - offsets[r0]
            doc, start, windows, code = segments(data[offsets[r0] : offsets[r1]], base)
            parts.append((doc + r0, (start - base[doc]).astype(np.int32), windows.astype(np.int16), code))
        row, start, windows, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(row):
            return None
        own = tags[row]
        order, first = _runs(code)
        low, high = np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)
        known = np.zeros(len(row), np.uint8)
        known[order[np.repeat(low < high, np.diff(np.append(first, len(order))))]] = 2
        known[order[first[low < high]]] = 1
        bucket = (code % _U(buckets)).astype(np.int64)
        bucket[known == 2] = np.arange(np.count_nonzero(known == 2)) % buckets
        # 48 bits of an anchor are enough to find candidates; they travel as two columns.
        return {"bucket": bucket, "high": (code >> _U(16)).astype(np.uint32), "low": (code & _U(0xFFFF)).astype(np.uint16), "tag": own, "start": start, "windows": windows, "known": known}

    return run


def _shared(groups: int):
    """Step 1, by bucket: the segments whose anchor has two documents, dealt to the groups of their documents."""

    def run(table: pa.Table) -> pa.Table:
        c = unpack_arrays(table["blob"])
        code = (c["high"].astype(_U) << _U(16)) | c["low"]
        test = np.flatnonzero(c["known"] < 2)
        order, first = _runs(code[test])
        order = test[order]
        keep = c["known"] == 2
        if len(order):
            tags = c["tag"][order]
            several = (np.minimum.reduceat(tags, first) < np.maximum.reduceat(tags, first)) | (np.maximum.reduceat(c["known"][order], first) > 0)
            keep[order[np.repeat(several, np.diff(np.append(first, len(order))))]] = True
        at = np.flatnonzero(keep)
        return _rows(_split(c["tag"][at] % groups, {n: c[n][at] for n in ("high", "low", "tag", "start", "windows")}, 0))

    return run


def _row_of(tags: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Row of each tag among ``have``: the first where rows repeat; -1 if there is none."""
    order = np.argsort(have, kind="stable")
    at = np.minimum(np.searchsorted(have[order], tags), len(order) - 1)
    return np.where(have[order[at]] == tags, order[at], -1)


def _cut_out(shards: int):
    """Step 2, by group: settled spans (kind 0, by group) and segments for the shards (kind 1)."""

    def run(key: tuple, marks: pa.Table, docs: pa.Table) -> pa.Table:
        if not marks.num_rows or not docs.num_rows:
            return _rows([])
        group = int(key[0].as_py())
        data, offsets = utf8(docs["text"])
        c = unpack_arrays(marks["blob"])
        c["code"] = (c.pop("high").astype(_U) << _U(16)) | c.pop("low")
        row = _row_of(c["tag"], _long(docs["tag"]))
        c["id"] = _long(docs["id"])[row]
        order = np.argsort(row, kind="stable")
        order = order[row[order] >= 0]
        c = {n: v[order] for n, v in c.items()}
        row = row[order]
        place = offsets[row] + c["start"]
        size = c["windows"].astype(np.int64) + LENGTH - 1
        code = np.empty(len(row), _U)
        for r0, r1 in slices(offsets):
            a, b = np.searchsorted(row, (r0, r1))
            part = data[offsets[r0] : offsets[r1]]
            total = np.zeros(len(part) + 1, _U)
            np.cumsum(mix(part.astype(_U) + _U(29)) * powers(len(part)), out=total[1:])
            s = place[a:b] - offsets[r0]
            code[a:b] = mix((total[s + size[a:b]] - total[s]) * powers(len(part) + 1, inverse=True)[s])
        order, first = _runs(c["windows"], c["code"], code)
        counts = np.diff(np.append(first, len(order)))
        least = np.minimum.reduceat(c["id"][order], first) if len(order) else c["id"]
        mine = np.repeat(least, counts) == c["id"][order]
        gone = order[~mine]
        out = [(0, group, pack_arrays(_CODEC, tag=c["tag"][gone], start=c["start"][gone], size=size[gone].astype(np.int32)))] if len(gone) else []
        unit = np.repeat(np.arange(len(first)), counts)[mine]
        head, stay = order[first], order[mine]
        shard = (mix(c["code"]) % _U(shards)).astype(np.int64)
        by_shard, cuts = _runs(shard[head])
        rank = np.empty(len(head), np.int64)
        rank[by_shard] = np.arange(len(head))
        occ = np.argsort(rank[unit], kind="stable")
        occ_unit, occ_row = rank[unit][occ], stay[occ]
        bounds = np.append(cuts, len(by_shard))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            h = head[by_shard[a:b]]
            x, y = np.searchsorted(occ_unit, (a, b))
            width = size[h]
            ends = np.cumsum(width)
            index = np.arange(ends[-1]) - np.repeat(ends - width, width) + np.repeat(place[h], width)
            o = occ_row[x:y]
            out.append((1, int(shard[h[0]]), pack_arrays(
                _CODEC, text=data[index], windows=c["windows"][h], code=code[h], anchor=(c["code"][h] & _U(0xFFFF)).astype(np.uint16),
                occ=(occ_unit[x:y] - a).astype(np.int32), id=c["id"][o], tag=c["tag"][o], start=c["start"][o],
            )))
        return _rows(out)

    return run


def _settle(groups: int):
    """Step 3, by kind and key: a shard's segments become spans to remove; spans already settled pass."""
    return lambda key, table: _spans(table, groups) if key[0].as_py() else table.select(["kind", "key", "blob"])


def _spans(table: pa.Table, groups: int) -> pa.Table:
    c = unpack_arrays(table["blob"], {"occ": "windows"})
    windows = c["windows"].astype(np.int64)
    size = windows + LENGTH - 1
    ends = np.cumsum(size)
    own_least = np.empty(len(windows), np.int64)
    own_least[c["occ"]] = c["id"]  # a group sends the occurrences of its smallest document only
    order, first = _runs(windows, c["anchor"], c["code"])
    counts = np.diff(np.append(first, len(order)))
    distinct = np.empty(len(order), np.int64)
    distinct[order] = np.repeat(np.arange(len(first)), counts)
    least = np.minimum.reduceat(own_least[order], first)
    head = order[first]
    width = size[head] + 1
    stop = np.cumsum(width)
    begin = stop - width
    unit = np.repeat(np.arange(len(head)), width)
    offset = np.arange(stop[-1]) - begin[unit]
    source = np.minimum((ends - size)[head][unit] + offset, len(c["text"]) - 1)
    text = np.where(offset == width[unit] - 1, np.uint8(_SEPARATOR), c["text"][source])
    suffixes = suffix_array(text, 256)
    common = permuted_lcp(text, suffixes, LENGTH)
    window = offset <= width[unit] - 1 - LENGTH
    owner = np.where(window, least[unit], _LAST)[suffixes]
    runs = np.flatnonzero(common[suffixes] < LENGTH)
    smallest = np.empty(len(text), np.int64)
    smallest[suffixes] = np.repeat(np.minimum.reduceat(owner, runs), np.diff(np.append(runs, len(text))))
    hit = window & (smallest < least[unit])
    # Runs of hit windows of each distinct segment, as spans of bytes.
    rise = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    fall = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
    span_unit, span_from, span_size = unit[rise], offset[rise], fall - rise + LENGTH
    of = distinct[c["occ"]]
    later = c["id"] > least[of]
    a, b = np.searchsorted(span_unit, of), np.searchsorted(span_unit, of, "right")
    n = np.where(later, 0, b - a)
    who = np.repeat(np.arange(len(of)), n)
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    full = np.flatnonzero(later)
    row = np.concatenate((full, who))
    start = np.concatenate((c["start"][full], c["start"][who] + span_from[which]))
    length = np.concatenate((size[head][of[full]], span_size[which]))
    return _rows(_split(c["tag"][row] % groups, {"tag": c["tag"][row], "start": start.astype(np.int32), "size": length.astype(np.int32)}, 0))


def _covered(spans: pa.Table, docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, offsets, covered) of a group's texts."""
    data, offsets = utf8(docs["text"])
    covered = np.zeros(len(data), bool)
    if spans.num_rows and len(data):
        c = unpack_arrays(spans["blob"])
        tags = _long(docs["tag"])
        row = _row_of(c["tag"], tags)
        order = np.argsort(row, kind="stable")
        row = row[order]
        start, size = offsets[row] + c["start"][order], c["size"][order]
        for r0, r1 in slices(offsets):
            a, b = np.searchsorted(row, (r0, r1))
            low, n = offsets[r0], offsets[r1] - offsets[r0] + 1
            edge = np.bincount(start[a:b] - low, minlength=n) - np.bincount(start[a:b] + size[a:b] - low, minlength=n)
            covered[low : offsets[r1]] = np.cumsum(edge)[:-1] > 0
        first = _row_of(tags, tags)
        for r in np.flatnonzero(first != np.arange(len(tags))):  # identical rows: spans came back to the first
            covered[offsets[r] : offsets[r + 1]] = covered[offsets[first[r]] : offsets[first[r] + 1]]
    return data, offsets, covered


def _digests(key: tuple, spans: pa.Table, docs: pa.Table) -> pa.Table:
    data, offsets, covered = _covered(spans, docs)
    n = np.diff(offsets)
    total = np.concatenate(([0], np.cumsum(covered, dtype=np.int32))).astype(np.int32)
    rise = covered & ~np.concatenate(([False], covered[:-1]))
    at = offsets[:-1][n > 0]
    rise[at] = covered[at]
    rises = np.concatenate(([0], np.cumsum(rise, dtype=np.int32))).astype(np.int32)
    kept = [hashlib.sha256(data[a:b][~covered[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ids = docs["doc_id"]
    return pa.table({"doc_id": ids, "n_bytes": n, "n_removed": (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64), "n_spans": (rises[offsets[1:]] - rises[offsets[:-1]]).astype(np.int64), "kept_sha256": kept})


def _cleaner(column: str, names: list[str]):
    def run(key: tuple, spans: pa.Table, docs: pa.Table) -> pa.Table:
        data, offsets, covered = _covered(spans, docs)
        total = np.concatenate(([0], np.cumsum(covered, dtype=np.int32)))
        texts = docs["text"].to_pylist()
        for r in np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]]):
            a, b = offsets[r], offsets[r + 1]
            texts[r] = data[a:b][~covered[a:b]].tobytes().decode("utf-8", "ignore")
        return pa.table([pa.array(texts, pa.string()) if n == column else docs[f"own_{i}"] for i, n in enumerate(names)], names=names)

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str, groups: int, *more: Column) -> DataFrame:
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST)))
    rows = docs.select(own.alias("id"), F.xxhash64(own, F.col(text)).alias("tag"), F.col(text).alias("text"), *more)
    return rows.withColumn("group", F.pmod("tag", F.lit(groups)))


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(packed spans by group, number of groups): what goes from every text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    buckets, groups, shards = (max(1, -(-int(size) // per)) for per in (BUCKET_BYTES, GROUP_BYTES, SHARD_BYTES))
    rows = _keyed(docs, doc_id, text, groups)
    tested = rows.select("tag", "text").mapInArrow(_anchors(buckets), _BLOB)
    shared = cut(tested.groupBy("key").applyInArrow(_shared(groups), _BLOB), "anchors")
    tidy(spark)
    marks = shared.select(F.col("key").alias("group"), "blob")
    found = marks.groupBy("group").cogroup(rows.groupBy("group")).applyInArrow(_cut_out(shards), _BLOB)
    spans = cut(found.groupBy("kind", "key").applyInArrow(_settle(groups), _BLOB), "spans")
    release(shared)
    tidy(spark)
    return spans.select(F.col("key").alias("group"), "blob"), groups


def _finish(docs: DataFrame, doc_id: str, text: str, fn: Callable, schema, *more: Column) -> DataFrame:
    spans, groups = removed_spans(docs, doc_id, text)
    rows = _keyed(docs, doc_id, text, groups, *more)
    return spans.groupBy("group").cogroup(rows.groupBy("group")).applyInArrow(fn, schema)


def removal_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _finish(docs, doc_id, text, _digests, schema, F.col(doc_id).cast("long").alias("doc_id"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, other columns unchanged, without the removed bytes."""
    more = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns) if c != text]
    return _finish(docs, doc_id, text, _cleaner(text, docs.columns), docs.schema, *more)

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import suffix_dedup
from nasty_cases import frame, nasty_texts

LAST = 2**63 - 1


def removal(rows):
    """(id, bytes) -> kept bytes, removed runs; from all windows of 50 bytes."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            own = LAST if i is None else i
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], own), own)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (LAST if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, b] = (len(b), sum(gone), runs, kept)
    return out


def family(n, seed=2):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(40, 130))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(8))]
        rows.append((rng.randrange(10**6), "".join(parts)))
    return rows + rows[:3]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20, 1 << 20), (4000, 2000, 1500)])
def test_against_all_windows(spark, monkeypatch, nothing, sizes):
    for name, size in zip(("BUCKET_BYTES", "GROUP_BYTES", "SHARD_BYTES"), sizes, strict=True):
        monkeypatch.setattr(suffix_dedup, name, size)
    rows = nasty_texts() + [(i + 100, t) for i, t in family(120)]
    docs = frame(spark, rows).repartition(4)
    want = removal(rows)
    got = suffix_dedup.removal_digests(docs).collect()
    assert len(got) == len(rows)
    left = {}
    for (i, b), (n, removed, runs, kept) in want.items():
        left.setdefault(i, set()).add((n, removed, runs, hashlib.sha256(kept).hexdigest()))
    for r in got:
        assert tuple(r)[1:] in left[r["doc_id"]], r
    cleaned = suffix_dedup.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    texts = sorted((r["doc_id"] or LAST, r["text"] or "") for r in cleaned.collect())
    assert texts == sorted((i or LAST, want[i, (t or "").encode()][3].decode("utf-8", "ignore")) for i, t in rows)


def test_no_rows(nothing):
    assert suffix_dedup.removal_digests(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).schema == nothing.schema


def test_segments_travel_compressed():
    """The rows between the steps are what fills the disk: segments and their tags are sent in under half their size."""
    rng = random.Random(5)
    common = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(common) for _ in range(400)) for _ in range(40)]
    docs = pa.table({"tag": pa.array(range(80), pa.int64()), "id": pa.array(range(80), pa.int64()), "text": texts * 2})
    tested = pa.Table.from_batches(suffix_dedup._anchors(1)(iter(docs.select(["tag", "text"]).to_batches())))
    sent = suffix_dedup._cut_out(1)((pa.scalar(0),), suffix_dedup._shared(1)(tested), docs)
    blob = sent.filter(pa.array(np.array(sent["kind"]) == 1))["blob"]
    arrays = suffix_dedup.unpack_arrays(blob)
    assert len(arrays["text"]) > 50_000
    assert sum(len(b.as_buffer()) for b in blob) < sum(v.nbytes for v in arrays.values()) / 2

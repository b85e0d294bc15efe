import hashlib
import random
import re

import numpy as np

from newsloom.llm import decontaminate
from nasty_cases import LOW_TABLE, PASSAGE, frame, nasty_texts


def find_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW_TABLE))


def expected(rows, items):
    phrases = {}
    for i, t in items:
        w = find_words(t)
        for g in ([tuple(w)] if 0 < len(w) < 10 else [tuple(w[k : k + 10]) for k in range(len(w) - 9)]):
            phrases.setdefault(g, set()).add(i)
    out = []
    for i, t in rows:
        w = find_words(t)
        hit, found = set(), set()
        for g, own in phrases.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_nasty(spark, nasty, nothing):
    items = [(1, PASSAGE + " and some words behind it for length"), (1, "one, two"), (None, "intro LINE"), (2, None), (3, "..."), (4, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(nasty, bench).collect()
    assert order(tuple(r)[:6] for r in got) == order(expected(nasty_texts(), items))
    clean = decontaminate.remove_passages(nasty, bench)
    assert clean.columns == nasty.columns
    assert {r["text"] for r in clean.filter("doc_id = 10").collect()} == {"\nOutro."}
    assert {r["text"] for r in clean.filter("doc_id = 16").collect()} == {t for i, t in nasty_texts() if i == 16}
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(nasty, bench.limit(0)).filter("contaminated").count() == 0


def test_many_parts_and_repetitive_text(spark, monkeypatch):
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    rows = [(i, draw(rng.randrange(60))) for i in range(40)]
    items = [(i, draw(rng.randrange(1, 16))) for i in range(25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    parts = decontaminate.item_phrases(bench, part_bytes=100)
    assert len(parts) > 1
    monkeypatch.setattr(decontaminate, "item_phrases", lambda *a, **k: parts)
    got = decontaminate.contamination(frame(spark, rows), bench).collect()
    assert order(tuple(r)[:6] for r in got) == order(expected(rows, items))


def test_index_finds_every_place():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = np.append(rng.integers(1, 5, rng.integers(1, 200)), 0)
        index = decontaminate.FMIndex(text, 5, sample=4)
        phrases = rng.integers(1, 5, (6, 3))
        low, high = index.search(phrases, np.full(6, 3))
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want

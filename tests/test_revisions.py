"""Revision links in time order against the sequential rule, and long chains in few rounds."""

import random

import pytest

from newsloom.operators import events

SCHEMA = "a string, b string, at string, cid string"


def sequential(links):
    label = {}
    for a, b, *_ in sorted(links, key=lambda r: (r[2], r[3], r[0], r[1])):
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        for k, v in label.items():
            if v == x:
                label[k] = y
    return label


def final(spark, links):
    return {r["bucket"]: r["final"] for r in events._follow_links(spark.createDataFrame(links, SCHEMA)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    """Many small groups side by side: trees, cycles, keys with several ways out, repeated and opposite links, equal times."""
    rnd = random.Random(seed)
    links = []
    for g in range(60):
        keys = [f"g{g}k{i}" for i in range(rnd.randint(2, 7))]
        for n in range(rnd.randint(1, 8)):
            a, b = rnd.sample(keys, 2)
            links.append((a, b, f"{rnd.randint(0, 5):02d}", f"{g}-{n}"))
    assert final(spark, links) == sequential(links)


@pytest.mark.parametrize("towards_head", [True, False])
def test_long_chains_take_few_rounds(spark, towards_head, monkeypatch):
    """10,000 links from key to key, and a second chain where a key in the middle also leads elsewhere."""
    written = []
    for name in ("cut", "cut_with"):
        monkeypatch.setattr(events, name, lambda df, label, _f=getattr(events, name), **kw: written.append(label) or _f(df, label, **kw))
    at = lambda i: f"{i if towards_head else 20_000 - i:05d}"
    links = [(f"k{i}", f"k{i + 1}", at(i), "") for i in range(10_000)]
    if not towards_head:
        links += [(f"m{i}", f"m{i + 1}", at(i), "") for i in range(1_000)] + [("m500", "x", "99999", "")]
    got = final(spark, links)
    assert {got[f"k{i}"] for i in range(10_001)} == {"k10000"}
    if not towards_head:
        assert {got[f"m{i}"] for i in range(1_001)} | {got["x"]} == {"x"}
    assert len(written) < 40

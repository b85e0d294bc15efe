import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words, ratio=10):
    count = Counter(words)
    vocab = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    form, out = {}, {}
    for w, n in vocab.items():
        others = sorted((-m, v) for v, m in vocab.items() if near(w, v))
        if others and -others[0][0] >= ratio * n:
            form[w] = others[0][1]
        out[w] = (n, len(others))
    for w in vocab:
        root = w
        while root in form:
            root = form[root]
        yield (w, form.get(w), root, *out[w], vocab.get(form.get(w)))


def slipped(doc_id, text):
    for run in RUN.findall(text or ""):
        w = run.translate(LOW)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
        yield w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]


def got(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("word", [(1,), (1, 1, 1), (2, 1, 2, 2, 3), (3, 2, 1, 1)])
def test_neighbourhood_is_full_and_without_repeats(word):
    k, symbols = len(word), (1, 2, 3)
    want = {word} | {word[:i] + word[i + 1 :] for i in range(k)} | {word[:i] + (s,) + word[i + 1 :] for i in range(k) for s in symbols} | {word[:i] + (s,) + word[i:] for i in range(k + 1) for s in symbols}
    key = {w: int(spelling.own_key(np.array([w], np.uint64).reshape(1, -1))[0][0, 0]) for w in want}
    for below, wanted in ((False, want), (True, {w for w in want if (len(w), w) <= (k, word)})):
        keys, counts = spelling.neighbourhood(np.array([word], np.uint64), 3, below)
        found = keys[counts].tolist()
        assert len(found) == len(set(found)) and set(found) == {key[w] for w in wanted}


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_near_pairs_by_brute_force(spark, symbols, monkeypatch):
    monkeypatch.setattr(spelling, "_PLACES", 7)
    rng = np.random.default_rng(symbols)
    words = sorted({"".join(rng.choice(list("aeéß漢"), n)) for n in rng.integers(1, 6, 120)} | {c * n + e for n in (62, 63, 64, 65, 200) for c in "xé" for e in ("", "y", "yx", "xy")})
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(vocab, symbols).collect()]
    assert sorted(pairs) == sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))


def test_variants_by_brute_force(spark):
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abcdefgé"), 8)) for _ in range(12)]
    words = []
    for s in stems:
        words += [s] * int(rng.integers(2, 400))
        for _ in range(6):
            i = int(rng.integers(len(s)))
            words += [s[:i] + str(rng.choice(list("abz"))) + s[i + int(rng.integers(2)) :]] * int(rng.integers(1, 9))
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert got(spelling.variants(frame)) == sorted(brute(words), key=repr)


def test_long_chain_of_forms(spark):
    """a-h: each one edit and ten times as frequent as the next."""
    counts = [("abcdefgh"[:i] + "z" * (8 - i), 3 * 10**i) for i in range(8, -1, -1)]
    links = spelling.forms(spark.createDataFrame(counts, "word string, n long")).filter("form IS NOT NULL").cache()
    assert links.count() == 8 and {r["root"] for r in spelling.roots(links).collect()} == {"abcdefgh"}
    assert spelling.roots(links.filter("false")).count() == 0


def test_documents(spark, nasty, nothing):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    rows += [(i, f"Étranger ÉTRANGER wonderful{'x' * (i % 3)} Wonderful×÷ {'longword' * 3000 if i % 9 == 0 else ''}") for i in range(200)]
    docs = nasty.select("doc_id", "text", "n", "key", "kept").unionByName(spark.createDataFrame(rows[nasty.count() :], "doc_id long, text string"), allowMissingColumns=True)
    want = sorted(brute([w for d, t in rows for w in slipped(d, t)]), key=repr)
    assert got(spelling.spelling_variants(docs)) == want and any(r[1] for r in want)
    assert spelling.spelling_variants(nothing).count() == 0

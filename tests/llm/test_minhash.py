import random
import re

from newsloom.llm import minhash
from nasty_cases import LOW_TABLE, frame, nasty_texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW_TABLE))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i != j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_nasty_documents(nasty, nothing):
    got = minhash.near_duplicates(nasty).collect()
    assert len(got) == nasty.count()
    want = components(nasty_texts())
    assert want[3] == 1 and want[9] == 7
    for r in got:
        if r["doc_id"] is not None and not (r["doc_id"] == 3 and r["n_shingles"] < 50):
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    # Without an id: joins its exact copies, and stands for nobody.
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {1, None}
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_first(nasty)
    assert kept.schema == nasty.schema and kept.filter("doc_id = 8").count() == 0 and kept.filter("doc_id = 7").count() == 1


def test_chains_and_families_against_all_pairs(spark):
    """Near copies of copies, with every degree of change, so that many links are not with a bucket's pivot."""
    rng = random.Random(5)
    rows = []
    for family in range(6):
        text = [f"f{family}w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(40):
            if rng.random() < 0.4:
                text = list(text)
                text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"y{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == components(rows)


def test_an_id_with_different_texts_is_one_document(spark):
    """Links of every text count for the id, whatever the sizes, and join what hangs on its other texts."""
    text = lambda name, n: [f"{name}{i}" for i in range(n)]
    near = lambda w: " ".join([*w[:-1], "changed"])
    a, b, c, d = text("a", 54), text("b", 504), text("c", 80), text("d", 80)
    rows = [(3, " ".join(a)), (5, near(a)), (5, " ".join(b)), (9, near(b)), (5, ""), (20, " ".join(c)), (21, " ".join(c)), (21, " ".join(d)), (22, " ".join(d)), (23, near(d))]
    want = components(rows)
    # Equal texts of two classes under one id: components() sees them through the id itself.
    assert want == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20}
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]), r


def test_nasty_documents_without_exemption(nasty):
    want = components(nasty_texts())
    assert all(r["component_id"] == want[r["doc_id"]] for r in minhash.near_duplicates(nasty).collect() if r["doc_id"] is not None)

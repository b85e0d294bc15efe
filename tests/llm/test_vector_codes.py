import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, total int, v int"
PLAIN = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain Python integers; rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = [v for _, v, _ in sorted((k for k in kept if k[1] and max(map(abs, k[1])) < 1 << 62), key=lambda k: (k[0] is None, k[0] or 0, k[1]))]
    width = len(usable[0]) if usable else 0
    size = -(-width // parts)

    def cut_up(v):
        v = v + [0] * (size * parts - len(v))
        return [v[p * size : (p + 1) * size] for p in range(parts)]

    books = [[cut_up(v)[p] for v in usable[:entries] if len(v) == width] for p in range(parts)]
    fits = [k for k in kept if width and len(k[1]) == width and max(map(abs, k[1])) < 1 << 62]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in fits:
            for p, x in enumerate(cut_up(v)):
                groups[p][assign(x, books[p])[1]].append(x)
        books = [[[sum(c) // len(c) for c in zip(*groups[p][k], strict=True)] if k in groups[p] else entry for k, entry in enumerate(books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, v, lab in kept:
        code = error = None
        if any(v is f[1] for f in fits):
            found = [assign(x, books[p]) for p, x in enumerate(cut_up(v))]
            code, error = "".join(f"{k:02x}" for _, k in found), sum(far for far, _ in found)
            by_label[lab] += error
        out.append((i, code, error, lab))
    fit = lambda n: n if n is not None and n < 1 << 63 else None
    return sorted(((i, code, fit(error), fit(by_label[lab]) if lab in by_label else None, sha) for i, code, error, lab in out), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("reach", [5, 2**12, 2**26, 2**29])
@pytest.mark.parametrize("inner", [1, 4, 7, 16])
def test_limbs_are_exact(reach, inner):
    rng = np.random.default_rng(inner)
    a, b = rng.integers(-reach, reach + 1, (40, inner)), rng.integers(-reach, reach + 1, (9, inner))
    a[0], b[0], b[1] = reach, reach, -reach
    assert (vector_codes.exact_dot(a, b).astype(object) == a.astype(object) @ b.T.astype(object)).all()


@pytest.mark.parametrize("scale", [1, 1e4, 3e6, 1e13, 2e15])
def test_codes_by_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=32).round(1) * scale).tolist(), int(i % 3) if i % 5 else None) for i in rng.permutation(150)]
    assert got(vector_codes.vector_codes(spark.createDataFrame(rows, PLAIN).repartition(3))) == brute(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(8)
    v = lambda n=20: [float(np.float32(x)) for x in rng.normal(size=n)]
    same = v()
    rows = [(i % 40, v(), i % 2) for i in range(80)]  # ids twice
    rows += [(3, same, 1), (3, same, 1), (None, v(), None), (None, same, 5), (0, v(7), 1), (-1, None, 0), (-2, [*v(19), None], 0), (-3, [*v(19), float("nan")], 0), (-4, [*v(19), float("-inf")], 0), (7, [], 9), (8, [*v(19), 3e38], 9)]
    frame = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA).repartition(4)
    out = got(vector_codes.vector_codes(frame))
    assert out == brute(rows) and len(out) == len(rows) - 4
    for few in (rows[:5], [], [(1, [], 1)], [(1, None, 1)]):
        small = spark.createDataFrame([(*r, "x", 1, 1) for r in few], SCHEMA)
        assert got(vector_codes.vector_codes(small)) == brute(few)


def test_reconstruction(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=32)], 0) for i in range(300)]
    frame = spark.createDataFrame(rows, PLAIN)
    books, width = vector_codes.train(frame)
    coded = vector_codes.compress(frame, books, width).collect()
    back = {r["vec_id"]: r["vector"] for r in vector_codes.reconstruct(vector_codes.compress(frame, books, width), books, width).collect()}
    for r in coded:
        whole = [math.floor(256 * x) for x in rows[r["vec_id"]][1]]
        assert sum((a - round(256 * b)) ** 2 for a, b in zip(whole, back[r["vec_id"]], strict=True)) == r["error"]

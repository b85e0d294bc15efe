"""Vectors as codes of small codebooks (product quantisation) in exact integer arithmetic.

Components become integers ``floor(scale * x)``; a vector is cut into equal consecutive parts, and each part position has a
codebook.  Squared distances come from |x|^2 - 2 x.c + |c|^2, where x.c is a float64 matrix product of limbs: integers are
broken into limbs so short that no product sum leaves 2^53, so every BLAS result is exact, and the limbs are put together in
int64.  The first argmin wins ties.  Values too large for int64 distances go through the same steps on Python integers.

Codebooks are trained on all vectors: a task adds up its parts per entry and sends one row per component in use, so what is
shuffled and collected is bounded by the codebooks (entries x dimensions), whatever the number of vectors.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped; a vector of another length
than that of the first kept id, or with an integer of 2^62 or more, stays with a null code and error; a length that the
parts do not divide is filled up with zeros; ids that are null come after all others, repeated ids are ordered by
their vectors, and every row keeps its own result; with fewer kept rows than entries the codebooks have as many entries as
rows; sums that leave a long are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut
from newsloom.operators.skew import attach_per_key

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_EXACT_BITS = 53
_LARGEST = 1 << 62
#: Vectors taken at a time.
_ROWS = 4096


def _limbs(values: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """``count`` float64 arrays with values = sum of limb k * 2^(bits k); the last limb keeps the sign."""
    low = [(values >> (bits * k)) & ((1 << bits) - 1) for k in range(count - 1)]
    return [x.astype(np.float64) for x in [*low, values >> (bits * (count - 1))]]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices by float64 products of limbs, right whenever the result fits int64."""
    inner = max(1, a.shape[1])
    bits = (_EXACT_BITS - (inner - 1).bit_length()) // 2
    sizes = [int(max(-int(x.min(initial=0)), int(x.max(initial=0)))).bit_length() for x in (a, b)]
    parts = [_limbs(x, bits, max(1, -(-size // bits))) for x, size in zip((a, b), sizes, strict=True)]
    out = np.zeros((a.shape[0], b.shape[0]), np.int64)
    for i, x in enumerate(parts[0]):
        for j, y in enumerate(parts[1]):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def nearest(rows: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance) of int64 rows; the distances are Python integers where int64 is too short."""
    reach = _largest(rows) + _largest(codebook)
    if rows.shape[1] * reach * reach >= 1 << 63:
        rows, codebook = rows.astype(object), codebook.astype(object)
        dots = rows @ codebook.T
    else:
        dots = exact_dot(rows, codebook)
    far = (rows * rows).sum(1)[:, None] - 2 * dots + (codebook * codebook).sum(1)[None, :]
    entry = np.argmin(far, 1)
    return entry, far[np.arange(len(far)), entry]


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, short, lengths, values) of a list column: rows without null or non-finite components, those of them whose
    integers all stay below the largest allowed, the lengths of all rows, and floor(scale * x) of all components."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    finite = np.isfinite(flat)
    scaled = np.floor(scale * np.where(finite, flat, 0.0))
    fits = np.abs(scaled) < _LARGEST
    ends = np.concatenate(([0], np.cumsum(lengths)))

    def none_of(bad: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(bad)))[ends]) == 0

    whole = column.is_valid().to_numpy(zero_copy_only=False) & none_of(~finite)
    return whole, whole & none_of(~fits), lengths, np.where(fits, scaled, 0.0).astype(np.int64)


def _cut_up(values: np.ndarray, parts: int) -> np.ndarray:
    """rows x components as parts x rows x components of a part, filled up with zeros."""
    size = -(-values.shape[1] // parts)
    padded = np.zeros((len(values), size * parts), np.int64)
    padded[:, : values.shape[1]] = values
    return padded.reshape(-1, parts, size).transpose(1, 0, 2)


def _matrix(column: pa.Array, width: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole rows, those of them with ``width`` integers, the parts of the latter)."""
    whole, short, lengths, values = integers(column, scale)
    own = short & (lengths == width) & (width > 0)
    return whole, own, _cut_up(values[np.repeat(own, lengths)].reshape(-1, max(1, width)), parts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _startable(scale: int):
    """(id, integers) of the rows that may start a codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            _, short, lengths, values = integers(batch.column(1), scale)
            own = short & (lengths > 0)
            ends = np.concatenate(([0], np.cumsum(lengths[own])))
            vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[np.repeat(own, lengths)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(own)), vectors], names=["vec_id", "v"])

    return run


def _sums(books: np.ndarray, width: int, scale: int):
    """Per task: for every component of every entry in use, the sum over its parts and their number."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for batch in _slices(batches):
            _, _, rows = _matrix(batch.column(0), width, parts, scale)
            wide = _largest(rows) * max(1, rows.shape[1]) >= 1 << 63
            for p in range(parts):
                entry, _ = nearest(rows[p], books[p])
                count[p] += np.bincount(entry, minlength=entries)
                own = np.zeros((entries, size), object if wide else np.int64)
                np.add.at(own, entry, rows[p].astype(own.dtype))
                total[p] += own
        used = np.argwhere(np.repeat((count > 0)[:, :, None], size, 2))
        place = np.ravel_multi_index(used.T, books.shape)
        sums = [str(v) for v in total.reshape(-1)[place]]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(sums, pa.string()), pa.array(count[used[:, 0], used[:, 1]])], names=["place", "total", "n"])

    return run


def _codes(books: np.ndarray, width: int, scale: int):
    """(id, label, vector) to id, label, code (two hex digits a part) and the error as decimal text, of whole rows."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            whole, own, rows = _matrix(batch.column(2), width, parts, scale)
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if own.any():
                found = [nearest(rows[p], books[p]) for p in range(parts)]
                digits = np.stack([entry for entry, _ in found], 1).astype(np.uint8)
                for i, code, error in zip(np.flatnonzero(own), digits, zip(*(far for _, far in found), strict=True), strict=True):
                    codes[i], errors[i] = code.tobytes().hex(), str(sum(map(int, error)))
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.string())], names=["vec_id", "label", "code", "total"])
            yield made.filter(pa.array(whole))

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[np.ndarray, int]:
    """(codebooks as parts x entries x components, width of the vectors) of (vec_id, embedding) rows.

    The start is the first ``entries`` vectors by id; each of ``rounds`` of assigning and averaging is one pass over all
    vectors.  No vector: no entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry takes two hex digits: 1 to 256 entries")
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    kept = vectors.select("vec_id", "embedding").mapInArrow(_startable(scale), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<long>")
    first = [r["v"] for r in kept.orderBy(*order).limit(entries).collect()]
    width = len(first[0]) if first else 0
    if not width:
        return np.zeros((parts, 0, 0), np.int64), 0
    books = _cut_up(np.array([v for v in first if len(v) == width], np.int64), parts)
    for _ in range(rounds):
        rows = vectors.select("embedding").mapInArrow(_sums(books, width, scale), "place int, total string, n long")
        # One row per component of a codebook at most.
        sums = rows.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        flat = books.reshape(-1).copy()
        for r in sums:
            flat[r["place"]] = int(r["total"]) // r["n"]
        books = flat.reshape(books.shape)
    return books, width


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' components as decimal text, by part, entry, place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, books: np.ndarray, width: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, total) of the whole vectors among (vec_id, label, embedding); total is the error as decimal."""
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    coded = vectors.select("vec_id", "label", "embedding").mapInArrow(_codes(books, width, scale), f"{kinds}, code string, total string")
    return coded.select("vec_id", "label", "code", F.expr("try_cast(total AS bigint)").alias("error"), F.expr("try_cast(total AS decimal(38,0))").alias("total"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per whole vector: vec_id, code, error, label_error (over equal labels, nulls together), codebooks_sha256.

    The coded rows are written once; labels are added up from them and joined back, broadcast by Spark if their file is
    small, else by an equi-join that splits a hot label.
    """
    books, width = train(vectors, parts, entries, rounds, scale)
    coded = cut(compress(vectors, books, width, scale), "codes")
    sums = coded.groupBy("label").agg(F.expr("try_cast(try_sum(total) AS bigint)").alias("label_error"))
    joined = attach_per_key(coded, cut(sums, "label_errors"), ["label"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def reconstruct(codes: DataFrame, books: np.ndarray, width: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, vector): the entries a code names, end to end, divided by the scale; a null code has a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [None if c is None else np.frombuffer(bytes.fromhex(c), np.uint8) for c in batch.column(1).to_pylist()]
            vectors = [None if e is None else (books[np.arange(len(books)), e].reshape(-1)[:width] / scale).tolist() for e in named]
            yield batch.append_column("vector", pa.array(vectors, pa.list_(pa.float64())))

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {codes.schema['vec_id'].dataType.simpleString()}, code string, vector array<double>")


ORACLE_SQL = """
WITH e AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM e, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS k, v FROM s WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
a0 AS (SELECT s.vec_id, s.p, min(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(s.v, b.v)]) * 64 + b.k) % 64 AS k FROM s JOIN b0 b USING (p) GROUP BY 1, 2),
u0 AS (SELECT p, k, list(CAST(floor(t / n) AS BIGINT) ORDER BY i) AS v FROM (SELECT a.p, a.k, i, sum(s.v[i + 1]) AS t, count(*) AS n FROM a0 a JOIN s USING (vec_id, p), (SELECT unnest(range(256)) AS i) WHERE i < len(s.v) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b1 AS (SELECT p, k, coalesce(u.v, b.v) AS v FROM b0 b LEFT JOIN u0 u USING (p, k)),
a1 AS (SELECT s.vec_id, s.p, min(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(s.v, b.v)]) * 64 + b.k) % 64 AS k FROM s JOIN b1 b USING (p) GROUP BY 1, 2),
u1 AS (SELECT p, k, list(CAST(floor(t / n) AS BIGINT) ORDER BY i) AS v FROM (SELECT a.p, a.k, i, sum(s.v[i + 1]) AS t, count(*) AS n FROM a1 a JOIN s USING (vec_id, p), (SELECT unnest(range(256)) AS i) WHERE i < len(s.v) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b2 AS (SELECT p, k, coalesce(u.v, b.v) AS v FROM b1 b LEFT JOIN u1 u USING (p, k)),
f AS (SELECT s.vec_id, s.label, s.p, CAST(min(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(s.v, b.v)]) * 64 + b.k) AS BIGINT) AS m FROM s JOIN b2 b USING (p) GROUP BY 1, 2, 3),
g AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM f GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256 FROM g
"""

"""Near-duplicate documents by min-max hashing, with exact confirmation on whole shingle sets.

Every permutation gives two signature values, the smallest and the largest image of the set, so 64 evaluations make
128 values; each equals its partner with probability J.  A band mixes two minima and two maxima of four different
permutations (32 bands of 4), so two sets at similarity 0.75 miss every band with probability 5e-6.

Documents with equal shingle sets are one class from the start and never meet as pairs.  Inside a bucket no pairs are
listed: each member meets the bucket's pivot, the member that shares most with others.  Only members the pivot does not
explain are compared further, and only where exact bounds leave room: a shingle that no other candidate has can
never be shared, so with c shingles left of n a link needs 7 min(c, c') >= 3 (n + n'); and every bit of a set's 512-bit
map that is missing from the other's is a shingle the other lacks.  A pair is compared in its first common bucket only.

Defined results: words are cut on ASCII blanks after lowering A-Z; null, empty and blank texts have no shingles and link
with nothing; fewer than five words are one shingle; rows that share an id are one document with the links of all its
texts; a row without an id joins its exact copies only; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, cut
from newsloom.llm.text_arrays import mix, shingle_sets, slices, space_table, span_hashes, utf8, words
from newsloom.operators.components import connected_components

SHINGLE = 5
PERMUTATIONS = 64
BANDS = 32
ROWS = 4

_U = np.uint64
_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
_SHIFTS = mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) * _U(0xE7037ED1A0B428DB))
_SIGNATURE = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
_SET = "doc_id long, n long, shingles binary, bits array<long>"
MAP_BITS = 512


def min_max(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima), each sets x permutations, of non-empty sets laid end to end."""
    low = np.empty((len(starts), PERMUTATIONS), _U)
    high = np.empty_like(low)
    for p in range(PERMUTATIONS):
        image = flat * _FACTORS[p] + _SHIFTS[p]
        low[:, p] = np.minimum.reduceat(image, starts)
        high[:, p] = np.maximum.reduceat(image, starts)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key per band: minima of permutations 2k, 2k+1 with maxima of two others half a turn away."""
    out = np.empty((len(low), BANDS), _U)
    half = PERMUTATIONS // 2
    for k in range(BANDS):
        key = np.full(len(low), _U(k + 1))
        for column in (low[:, 2 * k], low[:, 2 * k + 1], high[:, (2 * k + half) % PERMUTATIONS], high[:, (2 * k + 1 + half) % PERMUTATIONS]):
            key = mix(key * _U(0x9E3779B97F4A7C15) + column)
        out[:, k] = key
    return out


def _slices_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(1))
    for r0, r1 in slices(offsets):
        w = words(data, offsets[r0 : r1 + 1], space_table())
        yield r0, r1, *shingle_sets(w, span_hashes(w), SHINGLE)


def _sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for r0, r1, flat, bounds in _slices_of(batch):
        n = np.diff(bounds)
        full = np.flatnonzero(n > 0)
        f1, f2 = np.zeros(r1 - r0, _U), np.zeros(r1 - r0, _U)
        bands = np.zeros((0, BANDS), _U)
        if len(full):
            starts = bounds[full]
            f1[full] = np.add.reduceat(mix(flat), starts)
            f2[full] = np.add.reduceat(mix(flat ^ _U(0x94D049BB133111EB)), starts)
            bands = band_keys(*min_max(flat, starts))
        ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=["doc_id", "n_shingles", "f1", "f2", "bands"])


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for r0, r1, flat, bounds in _slices_of(batch):
        raw = pa.Array.from_buffers(pa.binary(), r1 - r0, [None, pa.py_buffer((bounds * 8).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        seen = np.zeros((r1 - r0, MAP_BITS), bool)
        seen[np.repeat(np.arange(r1 - r0), np.diff(bounds)), (flat >> _U(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)] = True
        maps = np.packbits(seen, axis=1, bitorder="little").view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(maps) + 1, MAP_BITS // 64, dtype=np.int32)), pa.array(maps))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), pa.array(np.diff(bounds)), raw, lists], names=["doc_id", "n", "shingles", "bits"])


def _tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(doc, shingle) rows, a slice of documents at a time."""
    data, offsets = utf8(batch.column(1))
    flat = data[offsets[0] : offsets[-1]].view(np.int64) if (offsets[0] % 8 == 0) else np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64)
    doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets) // 8)
    for a in range(0, len(flat), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(doc[a : a + 100_000]), pa.array(flat[a : a + 100_000])], names=["doc_id", "shingle"])


def _confirm(percent: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = (utf8(batch.column(i)) for i in (2, 3))
        linked = []
        for i in range(batch.num_rows):
            a = np.frombuffer(left[0][left[1][i] : left[1][i + 1]].tobytes(), _U)
            b = np.frombuffer(right[0][right[1][i] : right[1][i + 1]].tobytes(), _U)
            both = np.sort(np.concatenate((a, b)), kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            linked.append(100 * shared >= percent * (len(a) + len(b) - shared))
        yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the whole set, band keys (none for an empty set)."""
    return _pairs(docs, doc_id, text).mapInArrow(arrow_rows(_sign), _SIGNATURE)


def _pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _room(percent: int, c: Column, n: Column, c2: Column, n2: Column) -> Column:
    """Can sets of n and n2 shingles, of which c and c2 are not unique, reach the similarity?"""
    return (100 + percent) * F.least(c, c2) >= percent * (n + n2)


def _overlap(percent: int, bits: Column, n: Column, bits2: Column, n2: Column) -> Column:
    """The same question, from the bits that only one of the two maps has; no maps, no objection."""

    def lacking(a: Column, b: Column) -> Column:
        return sum((F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i]))) for i in range(1, MAP_BITS // 64)), F.bit_count(a[0].bitwiseAND(F.bitwise_not(b[0]))))

    common = F.least(n - lacking(bits, bits2), n2 - lacking(bits2, bits))
    return F.coalesce((100 + percent) * common >= percent * (n + n2), F.lit(True))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    # The few ends that many pairs share come in last, so the wide side moves once.
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(arrow_rows(_confirm(percent)), "a long, b long")


def links(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(node, root) of all classes that lie in a component of two or more; ``classes`` has rep, n and bands."""
    keyed = classes.filter(F.col("rep").isNotNull()).select("rep", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    inside = cut(keyed.join(shared, "bucket").distinct(), "buckets")
    wanted = inside.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(_pairs(docs, doc_id, text).join(wanted, "doc_id", "left_semi").mapInArrow(arrow_rows(_sets), _SET).filter("n > 0"), "sets")
    lone = (
        sets.select("doc_id", "shingles").mapInArrow(arrow_rows(_tokens), "doc_id long, shingle long")
        .groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).filter("doc_id = other")
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("lone"))
    )
    size = sets.groupBy("doc_id").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.sum("n").alias("all"), F.when(F.count(F.lit(1)) == 1, F.min("bits")).alias("bits"))
    # A document with several texts keeps the loosest bounds: its smallest n against all its shared shingles, no map.
    facts = size.join(lone, "doc_id", "left").select(F.col("doc_id").alias("rep"), "n", F.least("most", F.col("all") - F.coalesce("lone", F.lit(0))).alias("c"), "bits")
    facts = cut(facts, "facts")
    maps = facts.select("rep", "bits")
    member = cut(inside.join(facts.select("rep", "n", "c"), "rep").select("bucket", "rep", "n", "c"), "members")
    pivots = member.groupBy("bucket").agg(F.max_by(F.struct("rep", "n", "c"), F.struct(F.col("c") / F.col("n"), "c", -F.col("rep"))).alias("p"))
    pivots = cut(pivots.select("bucket", *[F.col(f"p.{x}").alias(f"p_{x}") for x in ("rep", "n", "c")]), "pivots")
    first = member.join(pivots, "bucket").filter((F.col("rep") != F.col("p_rep")) & _room(percent, F.col("c"), F.col("n"), F.col("p_c"), F.col("p_n")))
    first = first.select("rep", "n", "p_rep", "p_n").distinct().join(maps, "rep").join(maps.select(F.col("rep").alias("p_rep"), F.col("bits").alias("p_bits")), "p_rep")
    first = first.filter(_overlap(percent, F.col("bits"), F.col("n"), F.col("p_bits"), F.col("p_n"))).select(F.col("rep").alias("a"), F.col("p_rep").alias("b"))
    edges = cut(_confirmed(first, sets, percent), "edges")
    roots = cut(connected_components(edges), "roots")
    # Members of another component than their pivot's, and all they could still link with in the bucket.
    placed = member.join(roots, member.rep == roots.node, "left").select(*member.columns, F.coalesce("root", "rep").alias("root"))
    heads = pivots.join(roots, pivots.p_rep == roots.node, "left").select("bucket", "p_rep", F.coalesce("root", "p_rep").alias("p_root"))
    placed = cut(placed.join(heads, "bucket"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.min("n").alias("_least")).filter("_lo < _hi").select("bucket", "_least")
    loose = placed.filter(F.col("root") != F.col("p_root")).join(mixed, "bucket").filter((100 + percent) * F.col("c") >= percent * (F.col("n") + F.col("_least")))
    loose = cut(loose.select("bucket", "rep", "n", "c", "root"), "loose")
    # A pair is compared in its first common bucket only; a document has at most one bucket per band.
    homes = inside.groupBy("rep").agg(F.collect_list("bucket").alias("homes"))
    maps = cut(maps.join(homes, "rep"), "maps")
    u = loose.join(maps, "rep").select("bucket", *[F.col(x).alias(f"u_{x}") for x in ("rep", "n", "c", "bits", "root", "homes")])
    v = placed.filter(F.col("rep") != F.col("p_rep")).join(loose.select("bucket").distinct(), "bucket", "left_semi").join(maps, "rep")
    v = v.select("bucket", "rep", "n", "c", "bits", "homes", "root", (F.col("root") != F.col("p_root")).alias("open"))
    on = (u.bucket == v.bucket) & (F.col("u_root") != F.col("root")) & (~F.col("open") | (F.col("u_rep") < F.col("rep")))
    on = on & _room(percent, F.col("u_c"), F.col("u_n"), F.col("c"), F.col("n")) & _overlap(percent, F.col("u_bits"), F.col("u_n"), F.col("bits"), F.col("n"))
    on = on & (F.array_min(F.array_intersect("u_homes", "homes")) == u.bucket)
    more = u.join(v, on).select(F.col("u_rep").alias("a"), F.col("rep").alias("b")).distinct()
    late = cut(_confirmed(more, sets, percent), "late")
    if late.isEmpty():
        return roots
    return _joined(roots, late)


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) after more edges (a, b)."""
    known = roots.select(F.col("node").alias("_k"), F.col("root").alias("_r"))
    lifted = edges.join(known, edges.a == known["_k"], "left").select(F.coalesce("_r", "a").alias("a"), "b")
    lifted = lifted.join(known, lifted.b == known["_k"], "left").select("a", F.coalesce("_r", "b").alias("b"))
    above = connected_components(lifted).select(F.col("node").alias("_k"), F.col("root").alias("_r"))
    joined = roots.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    return joined.join(above, joined.root == above["_k"], "left").select("node", F.coalesce("_r", "root").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked id), kept (is it the smallest itself?)."""
    signed = cut(signatures(docs, doc_id, text), "signed")
    key = ["n_shingles", "f1", "f2"]
    classes = cut(signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "classes")
    roots = links(docs, classes, doc_id, text, percent)
    # Ids with different texts, and the classes of each: all are one document.
    differs = [F.min(k) != F.max(k) for k in key]
    several = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((differs[0] | differs[1] | differs[2]).alias("_differ")).filter("_differ").select("doc_id")
    own = signed.join(several, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes.select(*key, "rep"), key)
    own = cut(own.select("doc_id", "rep").distinct(), "own")
    first = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    edges = cut(own.join(first, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct(), "own_edges")
    if not edges.isEmpty():
        roots = cut(_joined(roots, edges), "roots")
    named = classes.select(*[F.col(k).alias(f"_{k}") for k in key], "rep")
    named = named.join(roots, named.rep == roots.node, "left").select(*[f"_{k}" for k in key], F.coalesce("root", "rep").alias("component"))
    joined = signed.select("doc_id", *key).join(named, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    # A text without shingles goes with the other texts of its id.
    by_id = first.join(roots, first.a == roots.node, "left").select(F.col("doc_id").alias("_id"), F.coalesce("root", "a").alias("_of_id"))
    joined = joined.join(by_id, joined.doc_id == by_id["_id"], "left")
    component = F.when(F.col("n_shingles") == 0, F.coalesce("_of_id", "doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The documents that stay, columns unchanged: one of each component; repeated rows of a kept id count once."""
    stays = near_duplicates(docs, doc_id, text, percent).filter("kept").select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, F.col(doc_id).cast("long").eqNullSafe(F.col("_stays")), "left_semi")

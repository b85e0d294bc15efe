"""Token ids as flat files of unsigned integers with 64-bit document offsets, and back by memory map.

A folder holds, for every shard k of the documents in ascending id order:

* ``tokens-k-*.bin``   the ids of its documents one after the other, each document closed by the end id; little-endian
  uint16 if the vocabulary and the end id fit, else uint32;
* ``docs-k-*.bin``     two int64 per document: its id and its number of ids;
* ``offsets-k-*.bin``  int64 places of the documents in the whole corpus, one more than there are documents;
* ``manifest/``        one Parquet row per shard: file names, counts, and its bases, which are prefix sums over the shards.

The documents are range partitioned and sorted by id, so a shard is one task's output.  A task writes under a name of its own
and the manifest, a written table, names the files that count: tasks that are repeated or run twice leave only orphans.
Files are opened through ``pyarrow.fs``, hence in any store it knows; local ones are memory-mapped.

The tokenizer is only asked once for every chunk that recurs.  A chunk starts at a blank or line feed that follows a character
which is no white space, or at a comma or full stop that follows a letter or digit.  No pre-token of a byte-level BPE reaches over
such a place, and none looks back, so the ids of a text are those of its chunks, one after the other (tested on whole texts).

Defined results: a null or empty text is one end id; text that spells a special token is ordinary text; repeated ids are
ordered by a hash of their text, then the text, and equal rows keep one entry each; null ids come last; an empty table writes an empty manifest and
reads as no rows.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm.common import cut, shared_dir

END_ID = 2
_WHITE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[ \n])")
_MARK = "\x1f"
_STARTS = (" ", "\n", ",", ".")
#: Texts in which one of _STARTS follows something else, or with the mark itself, are cut by the pattern above, one by one.
_WHITE_RE2 = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNEVEN = rf"[^A-Za-z0-9\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}][,.]|[{_WHITE_RE2}][ \n]|{_MARK}"
#: Chunks a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Characters encoded at a time.
GROUP_CHARS = 4_000_000
_SHARD = "shard int, tokens_file string, docs_file string, n_docs long, n_nulls long, n_tokens long"
_DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> _Encoder:
    return _Encoder(vocabulary)


class _Encoder:
    """Ids of many texts at once; every distinct chunk goes through the tokenizer once."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        # Offsets are not asked for.
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.vocabulary_size = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._ids = np.empty(1 << 16, np.uint32)
        self._ends = np.zeros(1, np.int64)

    def _places(self, chunks: list[str]) -> np.ndarray:
        if len(self._place) > REMEMBERED:
            self._forget()
        known = self._place
        new = [c for c in chunks if c not in known]
        if new:
            # Lists of ids are read once and given back at once: they are most of what a new chunk costs beside the tokenizer.
            made = [array("I", e.ids) for e in self._batch(new, add_special_tokens=False)]
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.frombuffer(b"".join(made), np.uint32)
            used = self._ends[-1]
            if used + len(flat) > len(self._ids):
                self._ids = np.concatenate((self._ids[:used], np.empty(max(len(flat), used), np.uint32)))
            self._ids[used : used + len(flat)] = flat
            at = len(self._ends) - 1
            self._ends = np.concatenate((self._ends, used + np.cumsum(lengths)))
            known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per text) of texts without nulls."""
        chunks, per_text = _chunks(texts)
        coded = chunks.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        begin, length = self._ends[place], self._ends[place + 1] - self._ends[place]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(begin - (ends - length), length)
        place += np.arange(total)
        ids = self._ids[place]
        before = np.concatenate(([0], ends))
        return ids, np.diff(before[np.concatenate(([0], np.cumsum(per_text)))])


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts, number of chunks per text)."""
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    marked = texts
    for start in _STARTS:
        marked = pc.replace_substring(marked, start, _MARK + start)
    lists = pc.split_pattern(marked, _MARK)
    if not uneven.any():
        return lists.flatten(), np.diff(lists.offsets.to_numpy())
    parts, counts = [], np.diff(lists.offsets.to_numpy())
    edges = np.flatnonzero(np.diff(uneven.astype(np.int8))) + 1
    for begin, end in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(texts)])), strict=True):
        if uneven[begin]:
            own = [_CUT.split(t) for t in texts[begin:end].to_pylist()]
            counts[begin:end] = [len(x) for x in own]
            parts.append(pa.array([c for x in own for c in x], texts.type))
        else:
            parts.append(lists[begin:end].flatten())
    return pa.concat_arrays(parts), counts


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about GROUP_CHARS; a longer text is a slice of its own."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths) // GROUP_CHARS
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(texts)]))
    for begin, end in zip(edges, edges[1:], strict=False):
        if end > begin:
            yield texts[begin:end]


def encode(texts: pa.Array, vocabulary: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with the end id after each, ids per text); a null is an empty text."""
    run = _encoder(vocabulary)
    ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for own in _groups(pc.fill_null(texts, "").cast(pa.large_string())):
        found, n = run(own)
        ids.append(np.insert(found, np.cumsum(n), end_id))
        counts.append(n + 1)
    return np.concatenate(ids), np.concatenate(counts)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


def _write_shard(folder: str, vocabulary: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{what}-{shard:05d}-{own}.bin" for what in ("tokens", "docs")]
        n_docs = n_nulls = n_tokens = 0
        tokens = docs = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tokens is None:
                tokens, docs = (store.open_output_stream(f"{path}/{name}") for name in names)
            ids, counts = encode(batch.column(1), vocabulary, end_id)
            tokens.write(ids.astype(kind).tobytes())
            doc_ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            docs.write(np.stack((doc_ids, counts), 1).astype("<i8").tobytes())
            n_docs, n_nulls, n_tokens = n_docs + batch.num_rows, n_nulls + batch.column(0).null_count, n_tokens + len(ids)
        if tokens is not None:
            tokens.close()
            docs.close()
            row = (shard, *names, n_docs, n_nulls, n_tokens)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in _SHARD.split(", ")])

    return run


def _write_offsets(folder: str):
    """Second pass over the shards: local counts and the base of the shard give offsets in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            names = []
            for docs_file, base in zip(batch.column("docs_file").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                counts = _mapped(store, f"{path}/{docs_file}", "<i8").reshape(-1, 2)[:, 1]
                names.append(docs_file.replace("docs-", "offsets-", 1).replace(".bin", f"-{uuid.uuid4().hex[:8]}.bin"))
                with store.open_output_stream(f"{path}/{names[-1]}") as out:
                    out.write((base + np.concatenate(([0], np.cumsum(counts)))).astype("<i8").tobytes())
            yield batch.append_column("offsets_file", pa.array(names, pa.string()))

    return run


def _mapped(store: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The integers of a file: mapped into memory where the store is a local or mounted folder, else read."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as data:
        return np.frombuffer(data.read(), kind)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", shards: int = 0) -> DataFrame:
    """Write the files of all documents below ``folder`` (shared, new) and return the manifest; 0 shards: as many as the size asks for."""
    spark = docs.sparkSession
    kind = "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    # Bounds of the ranges are sampled on the driver, so they hold a hash in place of the text.
    keys = (F.col("doc_id").asc_nulls_last(), F.col("h"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    placed = (rows.repartitionByRange(shards, *keys) if shards else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    made = cut(placed.mapInArrow(_write_shard(folder, vocabulary, end_id, kind), _SHARD), "shards")
    # One row per partition that held documents: the prefix sums run over these only.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = made.select(
        "*",
        F.coalesce(F.sum("n_docs").over(earlier), F.lit(0)).alias("first_doc"),
        F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("first_token"),
        F.lit(kind).alias("kind"),
        F.lit(end_id).alias("end_id"),
    )
    schema = f"{_SHARD}, first_doc long, first_token long, kind string, end_id int, offsets_file string"
    based.repartition(max(1, made.count())).mapInArrow(_write_offsets(folder), schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def _read_shards(folder: str, wanted):
    """``wanted``(ids of a document) gives the last column of the rows that are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                tokens = _mapped(store, f"{path}/{shard['tokens_file']}", shard["kind"])
                offsets = _mapped(store, f"{path}/{shard['offsets_file']}", "<i8")
                doc_ids = _mapped(store, f"{path}/{shard['docs_file']}", "<i8")[::2]
                local = offsets - shard["first_token"]
                if local[-1] != len(tokens) or len(local) != shard["n_docs"] + 1:
                    raise ValueError(f"{shard['tokens_file']} does not hold what the manifest says")
                known = shard["n_docs"] - shard["n_nulls"]
                for begin in range(0, shard["n_docs"], 10_000):
                    own = range(begin, min(begin + 10_000, shard["n_docs"]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(doc_ids[i]) if i < known else None for i in own], pa.int64()),
                            pa.array(offsets[own.start : own.stop]),
                            pa.array(np.diff(local[own.start : own.stop + 1])),
                            pa.array([wanted(tokens[local[i] : local[i + 1]]) for i in own]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return run


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def _all(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int64)


def _open(spark: SparkSession, folder: str, wanted, schema: str) -> DataFrame:
    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(_read_shards(folder, wanted), schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder: doc_id, start in the corpus, n_tokens and ids, from the mapped files; a shard is a task."""
    return _open(spark, folder, _all, "doc_id long, start long, n_tokens long, ids array<long>")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`read`, with the crc32 of the ids as little-endian uint32 in place of the ids."""
    return _open(spark, folder, _checksum, _DOCUMENT.replace("ids_crc32", "ids")).withColumnRenamed("ids", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str = "", end_id: int = END_ID) -> DataFrame:
    """Write the documents to the shared folder, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end_id)
    return checksums(spark, folder)

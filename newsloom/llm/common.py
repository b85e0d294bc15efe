"""Helpers shared by the operators of this folder: tables, words as columns, written cuts."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import session
from newsloom.session import cut, release, shared_dir  # noqa: F401  (re-exported for the operators)


def prepare(spark: SparkSession) -> SparkSession:
    """The session's settings, but for the bound of rows by bytes: these operators cut their groups themselves."""
    session.prepare(spark).conf.unset(session.BATCH_BYTES)
    return spark


SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrow_rows(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A batch-to-batches function as the iterator function that ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return run


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that shuffle files of finished steps go before the next ones.

    The cleaner works beside the driver on what a collection has found; it gets a moment before the next step begins.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def pack_arrays(codec: str | None = None, /, **columns: np.ndarray) -> bytes:
    """Named arrays of any lengths as one Arrow message: many small values travel as one row.  ``codec`` (zstd, lz4)
    compresses every array by itself; readers need not know it."""
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_arrays(blobs: pa.ChunkedArray, shift: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """The arrays of all messages laid end to end; ``shift`` raises index arrays by the length of others so far."""
    parts: dict[str, list[np.ndarray]] = {}
    seen: dict[str, int] = {}
    for blob in blobs:
        with pa.ipc.open_stream(blob.as_buffer()) as stream:
            batch = stream.read_next_batch()
        own = {n: batch.column(i).flatten().to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        for index, of in (shift or {}).items():
            own[index] = own[index].astype(np.int64) + seen.get(of, 0)
        for n, v in own.items():
            parts.setdefault(n, []).append(v)
            seen[n] = seen.get(n, 0) + len(v)
    return {n: np.concatenate(v) for n, v in parts.items()}

"""The repeated refresh as Structured Streaming: dedupe, memory, stories, revisions, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from newsloom import fixed_values as fv
from newsloom.functions import times
from newsloom.operators.stories import WINDOW
from newsloom.streaming.keyed import LastDigest, RejectionMemory, StoryAnchors, VersionMemory
from newsloom.streaming.state import BatchTable, run_to_end


def distinct_version_stream(stream: DataFrame, now: Column, lookback_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """Fresh entries, each (entry_id, fingerprint) once.

    The filter enforces both bounds of the look-back; the watermark only lets Spark forget versions that
    can no longer pass it.
    """
    fresh = stream.filter(times.fresh(F.col("published"), now, lookback_days))
    return fresh.withWatermark("published", f"{lookback_days} days").dropDuplicatesWithinWatermark(["entry_id", "fingerprint"])


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, folder: str, delay_days: int | None) -> DataFrame:
    """Run rows with ``published`` through the state of their key to the end of what is available; the rows put out so far."""
    if delay_days is not None:
        stream = stream.withWatermark("published", f"{delay_days} days")
    out = stream.groupBy(key).transformWithStateInPandas(processor, schema, "append", "None" if delay_days is None else "EventTime")
    return stream.sparkSession.read.schema(schema).parquet(run_to_end(out, folder))


#: Buckets that many keys share the calls of their state in; a job's progress folder holds state by bucket, so it keeps this number.
BUCKETS = 256


def _bucketed(stream: DataFrame, key: str) -> DataFrame:
    """The rows with their key as text and its ``bucket``."""
    return stream.withColumn(key, F.col(key).cast("string")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def _timed(stream: DataFrame, *columns: str | Column) -> DataFrame:
    return stream.select(*columns, F.unix_micros("published").alias("t"), "published")


def new_versions_job(stream: DataFrame, folder: str, keep_days: int = fv.RETENTION_DAYS, delay_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """id, fingerprint, t, revision_of: every unseen version of an entry with the version it revises, exactly once.

    ``stream``: id (long), entry_id, fingerprint, published.
    """
    schema = "id long, fingerprint string, t long, revision_of long"
    return _keyed(_bucketed(_timed(stream, "id", "entry_id", "fingerprint"), "entry_id"), "bucket", VersionMemory(keep_days), schema, folder, delay_days)


def rejection_memory_job(stream: DataFrame, folder: str, days: int = fv.REJECTED_MEMORY_DAYS, delay_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """ids that pass: entries whose key was not turned down in the ``days`` days before.

    ``stream``: id (long), key, rejected, published.
    """
    return _keyed(_bucketed(_timed(stream, "id", "key", "rejected"), "key"), "bucket", RejectionMemory(days), "id long", folder, delay_days)


def story_job(stream: DataFrame, folder: str, window: int = WINDOW, delay_days: int = fv.LOOKBACK_DAYS) -> DataFrame:
    """(id, story) of headlines over micro-batches: anchors of earlier batches first, then new ones.

    Batches in time order give the result of one batch.  A late card joins an anchor within the window
    on either side, as in the batch rule, and never moves an anchor that was already published.
    ``stream``: id (long), head, published.
    """
    return _keyed(_timed(stream, "id", "head"), "head", StoryAnchors(window), "id long, story long", folder, delay_days)


def revision_job(stream: DataFrame, folder: str) -> DataFrame:
    """article_id, seq, digest, outcome, previous: new, changed, duplicate or invalid against the digest before.

    ``stream``: article_id, seq (long), digest.
    """
    schema = "article_id string, seq long, digest string, outcome string, previous string"
    return _keyed(stream.select("article_id", "seq", "digest"), "article_id", LastDigest(), schema, folder, None)


def latest_review_stream(stream: DataFrame) -> DataFrame:
    """Running last decision per (event_id, revision) as a native streaming aggregate."""
    return stream.groupBy("event_id", "revision").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


LATEST = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("revision", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


def review_job(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """The last decision per (event_id, revision): every micro-batch writes only the keys that it changed."""
    table = BatchTable(spark, f"{folder}/latest", LATEST)

    def on_batch(batch: DataFrame, number: int) -> None:
        table.write(batch.withColumn("revision", F.col("revision").cast("string")), number)

    run_to_end(latest_review_stream(stream), folder, on_batch, "update")
    return table.all().groupBy("event_id", "revision").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))

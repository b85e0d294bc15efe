"""The scheduled refresh as a stream: one micro-batch writes several tables that agree with each other, and can be replayed.

Tables below the job's folder, each partitioned by ``batch`` (and by day where a later batch asks for some days only):

* ``cards/date=/batch=``      published cards; a date partition is a published day
* ``rejected/day=/batch=``    entry ids turned down: irrelevant ones, and releases that were only edited
* ``invalid/batch=``          cards that fail the contract, with their errors: not published, not remembered
* ``days/batch=``             days touched by the batch with their number of new cards, and days that expired
* ``runs/batch=``             one row of counts; written last, so a batch without it is not finished

A batch reads rows of earlier batches only and overwrites nothing but its own partitions.  So a batch that broke off half-way
is simply run again, and one that is run twice changes nothing.  Only days that a rule can still ask for are read: cards
within the retention, rejections within their memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed_values as fv
from newsloom.operators import entries
from newsloom.operators.rules import RuleSet
from newsloom.operators.validators import validate_cards
from newsloom.plans.refresh import candidates
from newsloom.schemas import CARD
from newsloom.session import cut_with, release
from newsloom.sources.files import drop_expired_days
from newsloom.streaming.state import BatchTable, run_to_end


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DateType(), T.BooleanType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


REJECTED = _fields(entry_id=_S, day=_D, reason=_S)
INVALID = _fields(id=_S, url=_S, errors=T.ArrayType(_S))
DAYS = _fields(date=_D, added=_L, expired=_B)
RUNS = _fields(now=T.TimestampType(), fresh=_L, matched=_L, added=_L, rejected=_L, stale=_L, invalid=_L, expired=_L)


class DayTable(BatchTable):
    """A table partitioned by a day column, then by batch: readers of some days open only those."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, day: str):
        super().__init__(spark, path, schema)
        self.day = day

    def since(self, batch: int, first_day: Column) -> DataFrame:
        return self.before(batch).filter(F.col(self.day) >= first_day)

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        """Overwrite the batch's own partitions; rows without a day cannot be placed and are refused by the caller's checks."""
        rows = df.select(*self.schema.fieldNames(), F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day, "batch").parquet(self.path)
        return df


class Refresh:
    """Feed entries of one landing after the other to published days.

    ``brief`` adds what the summary step says about an item: relevant, headline, summary, gps, sectors, region, relevance_reason.
    Entries carry ``landed_at``; the latest of a batch is its clock.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: RuleSet, brief: Callable[[DataFrame], DataFrame], window_days: int = fv.RETENTION_DAYS):
        self.spark, self.rules, self.brief, self.window_days = spark, rules, brief, window_days
        self.cards = DayTable(spark, f"{folder}/cards", CARD, "date")
        self.rejected = DayTable(spark, f"{folder}/rejected", REJECTED, "day")
        self.invalid = BatchTable(spark, f"{folder}/invalid", INVALID)
        self.days = BatchTable(spark, f"{folder}/days", DAYS)
        self.runs = BatchTable(spark, f"{folder}/runs", RUNS)

    def on_batch(self, batch: DataFrame, number: int) -> None:
        clock = batch.agg(F.max("landed_at")).first()[0]
        if clock is None:
            return
        now = F.lit(clock)
        today = F.to_date(now)
        known = self.cards.since(number, F.date_sub(today, self.window_days))
        turned_down = self.rejected.since(number, entries.rejected_cutoff(now))
        picked = candidates(batch, self.rules, known, turned_down, now).drop("gps", "sectors")
        # Nothing to file it under: the summary step found no subject.
        subject = F.coalesce(F.col("relevant"), F.lit(False)) & (F.coalesce(F.size("gps") + F.size("sectors"), F.lit(0)) > 0)
        items = entries.stale_modified(self.brief(entries.to_item(picked)), now)
        items = items.withColumn("turned", F.when(F.col("stale"), "only edited").when(~subject, "irrelevant"))
        one = F.lit(1)
        staged, seen = cut_with(items, "refresh-items", matched=F.count(one), stale=F.count_if(F.col("stale")), rejected=F.count_if(F.col("turned") == "irrelevant"))
        seen_at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        cards = validate_cards(entries.make_cards(staged.filter("turned IS NULL"), observed_at=seen_at), self.rules.gps, self.rules.sectors)
        # What is already too old is refused, as it would be dropped at the end of this very batch.
        valid = F.size("errors") == 0
        inside = F.col("date") >= F.date_sub(today, self.window_days)
        made, checked = cut_with(cards, "refresh-cards", added=F.count_if(valid & inside), invalid=F.count_if(~valid))
        kept = made.filter(valid & inside)
        turned = staged.filter("turned IS NOT NULL").select("entry_id", today.alias("day"), F.col("turned").alias("reason"))

        self.cards.write(kept.select(*[F.col(f.name).cast(f.dataType) if f.name in kept.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CARD.fields]), number)
        self.rejected.write(turned, number)
        self.invalid.write(made.filter(~valid).select("id", F.col("source.url").alias("url"), "errors"), number)
        # What expires follows from the days of earlier batches, not from the files that are left, so it is the same when run again.
        before = self.days.before(number).groupBy("date").agg(F.max("expired").alias("gone"), F.lit(0).cast("long").alias("added"))
        expired = before.filter(~F.col("gone") & (F.col("date") < F.date_sub(today, self.window_days))).select("date", "added", F.lit(True).alias("expired"))
        touched = kept.groupBy("date").agg(F.count(F.lit(1)).alias("added")).withColumn("expired", F.lit(False))
        days = self.days.write(touched.unionByName(expired), number)
        drop_expired_days(self.spark, self.cards.path, clock.date(), self.window_days)
        counts = {"fresh": entries.fresh_entries(batch, now).count(), **seen, **checked, "expired": days.filter("expired").count()}
        row = [F.lit(clock).alias("now"), *[F.lit(n).cast("long").alias(name) for name, n in counts.items()]]
        self.runs.write(self.spark.range(1).select(*row), number)
        for frame in (staged, made):
            release(frame)


def refresh_stream(stream: DataFrame, folder: str, rules: RuleSet, brief: Callable[[DataFrame], DataFrame], window_days: int = fv.RETENTION_DAYS) -> Refresh:
    """Refresh with everything that has landed; called again, it goes on from there.  Returns the job and its tables."""
    job = Refresh(stream.sparkSession, folder, rules, brief, window_days)
    run_to_end(stream, folder, job.on_batch)
    return job

"""Day files, JSONL, label sheets, and the partitioned tables that are published."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from newsloom import fixed_values as fv
from newsloom.schemas import CARD


def read_cards(spark: SparkSession, folder: str, schema: T.StructType = CARD) -> DataFrame:
    """Every ``YYYY-MM-DD.json`` day file under a folder, items flattened; other files are ignored."""
    day_schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("items", T.ArrayType(schema))])
    files = (
        spark.read.schema(day_schema)
        .option("multiLine", True)
        .option("pathGlobFilter", "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].json")
        .json(folder)
    )
    return files.select(F.explode("items").alias("c")).select("c.*")


@F.pandas_udf(T.StringType())
def _json_fault(lines: pd.Series) -> pd.Series:
    """Why a line is not strict JSON: duplicate keys and non-finite numbers are faults too."""

    def unique(pairs):
        keys = [k for k, _ in pairs]
        for i, k in enumerate(keys):
            if k in keys[:i]:
                raise ValueError(f"Duplicate JSON key: {k}")
        return dict(pairs)

    def finite(value):
        raise ValueError(f"Non-finite JSON value: {value}")

    def one(line):
        try:
            json.loads(line, object_pairs_hook=unique, parse_constant=finite)
        except ValueError as error:
            return str(error)
        return None

    return lines.map(one)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON lines with a ``fault`` column; rows with a fault keep their raw line."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return check_json(lines, "value", schema)


def check_json(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    out = lines.withColumn("fault", _json_fault(F.col(column)))
    parsed = F.when(F.col("fault").isNull(), F.from_json(F.col(column), schema))
    return out.withColumn("row", parsed).withColumn(column, F.when(F.col("fault").isNotNull(), F.col(column)))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label or ledger sheet: header, all strings, byte-order mark stripped from the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_jsonl(df: DataFrame, path: str) -> None:
    """Refuses to overwrite existing evidence."""
    df.write.mode("errorifexists").json(path)


def write_days(spark: SparkSession, new_cards: DataFrame, table: str, today: Column, window_days: int = fv.RETENTION_DAYS) -> DataFrame:
    """Merge new cards into a table partitioned by day; returns the cards actually added.

    Known ids and days before the window are skipped.  Only touched day partitions are rewritten
    (dynamic partition overwrite), newest first inside a day.
    """
    from newsloom.session import cut

    cutoff = F.date_sub(today, window_days)
    # Of several new cards with one id the newest stays, then the one with the smallest digest.
    order = [F.col("published_at").desc_nulls_last(), F.sha2(F.to_json(F.struct(*new_cards.columns)), 256)]
    rows = new_cards.filter(F.col("date") >= cutoff)
    fresh = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("_nth = 1").drop("_nth")
    # Only a table that does not exist counts as empty; any other failure stops the job before a day is rewritten.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    known = spark.read.schema(new_cards.schema).parquet(table) if exists else spark.createDataFrame([], new_cards.schema)
    added = cut(fresh.join(known.select("id"), "id", "left_anti").select(*new_cards.columns), "added")
    days = F.broadcast(added.select("date").distinct())
    touched = known.join(days, "date", "left_semi").select(*new_cards.columns)
    merged = cut(touched.unionByName(added), "merged-days")
    (
        merged.repartitionByRange("date", F.col("published_at").desc())
        .sortWithinPartitions("date", F.col("published_at").desc_nulls_last())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(table)
    )
    return added


def drop_expired_days(spark: SparkSession, table: str, today, window_days: int = fv.RETENTION_DAYS) -> list[str]:
    """Delete day partitions older than the window; only the partition names reach the driver."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    cutoff = pd.Timestamp(today) - pd.Timedelta(days=window_days)
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("date=") and pd.Timestamp(name[5:]) < cutoff:
            fs.delete(status.getPath(), True)
            gone.append(name[5:])
    return sorted(gone)


def write_partitioned(df: DataFrame, table: str, by: str = "date") -> None:
    """One partition per day; days without rows get no partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(table)


def write_index(cards: DataFrame, path: str) -> None:
    cards.groupBy("date").agg(F.count("*").alias("count")).orderBy(F.col("date").desc()).write.mode("overwrite").parquet(path)


def review_rows(decisions: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Flat review sheet: lists joined by blanks, nulls empty, one row per decision.

    ``members``: event_id, pos, article_id.
    """
    links = (
        members.join(evidence.select("article_id", "original_url"), "article_id", "left")
        .groupBy("event_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", "original_url"))).alias("m"))
    )
    gate = lambda s: F.array_join(F.array_sort(F.map_keys(F.map_filter("gates", lambda k, v: v == s))), " ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return decisions.join(links, "event_id", "left").select(
        "event_id",
        "recommendation",
        text("total_score").alias("total_score"),
        text("relevance_level").alias("relevance_level"),
        "primary_event_type",
        "primary_region",
        F.array_join(F.transform("m", lambda x: x["article_id"].cast("string")), " ").alias("article_ids"),
        F.array_join(F.filter(F.transform("m", lambda x: x["original_url"]), lambda u: u != ""), " ").alias("source_urls"),
        F.array_join("disposition_reason_codes", " ").alias("disposition_reason_codes"),
        gate("fail").alias("failed_gates"),
        gate("review_required").alias("review_reason"),
    )


def write_review_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def reviewed_cards(decisions: DataFrame, drafts: DataFrame, sources: DataFrame, reviews: DataFrame, dates: DataFrame) -> DataFrame:
    """Rendered cards that are approved exactly as drafted.

    ``drafts``: event_id, status, content_hash, and the six texts.  ``sources``: event_id, publisher, url,
    title.  ``dates``: event_id, date.
    """
    from newsloom.operators.ledger import approved_only

    ready = drafts.filter(F.col("status") == "ready_for_analyst_review").join(decisions, "event_id")
    ok = approved_only(ready, reviews)
    listed = sources.join(ok.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("publisher", "url", "title"))).alias("sources")
    )
    lang = lambda x: F.struct(
        F.col(f"headline_{x}").alias("headline"), F.col(f"summary_{x}").alias("summary"), F.col(f"interpretation_{x}").alias("why_it_matters")
    )
    return ok.join(listed, "event_id", "left").join(dates, "event_id", "left").select(
        "event_id",
        F.coalesce(F.col("date").cast("string"), F.lit("undated")).alias("date"),
        F.lit("reviewed").alias("partition"),
        F.lit("analyst_approved").alias("status"),
        "recommendation",
        "relevance_level",
        "total_score",
        "primary_event_type",
        lang("en").alias("en"),
        lang("zh").alias("zh"),
        F.array_sort(F.array_union("direct_entity_ids", "propagated_entity_ids")).alias("entities"),
        "sector_ids",
        "primary_region",
        "sources",
    )

"""The refresh stream: tables that agree, a batch broken off half-way, an invalid card, expired days, remembered rejections."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.rules import RuleSet, Tag
from newsloom.streaming import refresh
from newsloom.streaming.state import arrivals, job_folder

RULES = RuleSet(gps={"alpha": Tag(("alpha",))}, sectors={}, context=(), event=("buys",), exclude=())
ENTRY = "feed string, title string, url string, publisher string, published timestamp, description string, origin string, domains array<string>, feed_tags array<string>, form string, discovery string, published_basis string, source_published_at string, landed_at timestamp, arrival int"


def entry(url, day, arrival, title="alpha buys beta", **more):
    base = {"feed": "f", "title": title, "url": f"https://x.example/{url}", "publisher": "P", "published": dt.datetime(2024, 3, day, 6), "description": "", "landed_at": dt.datetime(2024, 3, day, 7), "arrival": arrival}
    return {**{c.split()[0]: None for c in ENTRY.split(", ")}, **base, **more}


def brief(items):
    return items.withColumns(
        {
            "relevant": ~F.col("title").contains("dull"), "headline": F.struct(F.col("title").alias("en"), F.lit("标").alias("zh")),
            "summary": F.struct(F.when(F.col("title").contains("broken"), "").otherwise("It closed.").alias("en"), F.lit("摘").alias("zh")), "gps": F.array(F.lit("alpha")),
            "sectors": F.array().cast("array<string>"), "region": F.lit("US"), "relevance_reason": F.lit("r"),
        }
    )


ENTRIES = [
    entry("a", 1, 0), entry("dull", 1, 0, "alpha buys dull"), entry("broken", 1, 0, "alpha buys broken"), entry("off", 1, 0, "gamma sells"),
    entry("old", 1, 0, "alpha buys old", published_basis="sitemap_lastmod", source_published_at="2024-01-05"),
    entry("a", 2, 1), entry("a", 2, 1, "alpha buys beta, again"), entry("dull", 2, 1, "alpha buys dull"), entry("old", 2, 1, "alpha buys old"), entry("b", 2, 1, published=dt.datetime(2024, 2, 20)),
    entry("c", 20, 2), entry("dull", 20, 2, "alpha buys dull"), entry("d", 20, 2, published=dt.datetime(2024, 3, 20, 9)),
]


def tables(spark, job):
    out = {}
    for name in ("cards", "rejected", "invalid", "days", "runs"):
        own = getattr(job, name)
        rows = spark.read.schema(T.StructType([*own.schema.fields, T.StructField("batch", T.LongType())])).parquet(own.path)
        out[name] = sorted((r.asDict(recursive=True) for r in rows.collect()), key=repr)
    return out


@pytest.fixture(scope="module")
def refreshed(spark):
    folder, jobs = job_folder(spark, "refresh"), []
    landed = spark.createDataFrame([tuple(e.values()) for e in ENTRIES], ENTRY)
    arrivals(landed, F.col("arrival"), 3, f"{folder}/in", lambda s: jobs.append(refresh.refresh_stream(s, folder, RULES, brief, 10)))
    return jobs[-1], landed, tables(spark, jobs[-1])


def test_what_became_of_the_entries(refreshed):
    _, _, found = refreshed
    assert [(c["source"]["url"][-1], str(c["date"])) for c in found["cards"]] == [("c", "2024-03-20")]  # March 1 and 2 have expired
    assert sorted((r["reason"], str(r["day"])) for r in found["rejected"]) == [("irrelevant", "2024-03-01"), ("irrelevant", "2024-03-20"), ("only edited", "2024-03-01")]
    assert [(r["url"][-6:], r["batch"]) for r in found["invalid"]] == [("broken", 0)]
    runs = {r["batch"]: r for r in found["runs"]}
    assert [runs[b]["fresh"] for b in range(3)] == [5, 4, 2]
    assert [(runs[b]["added"], runs[b]["rejected"], runs[b]["stale"], runs[b]["invalid"], runs[b]["expired"]) for b in range(3)] == [(1, 1, 1, 1, 0), (1, 0, 0, 0, 0), (1, 1, 0, 0, 2)]
    assert sorted((str(d["date"]), d["expired"], d["batch"]) for d in found["days"]) == [("2024-03-01", False, 0), ("2024-03-01", True, 2), ("2024-03-02", False, 1), ("2024-03-02", True, 2), ("2024-03-20", False, 2)]


def test_replay(spark, refreshed, monkeypatch):
    """The last batch breaks off after its first table, then runs again; then once more."""
    job, landed, before = refreshed
    last = landed.filter("arrival = 2").drop("arrival")

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(job.rejected, "write", stop)
    with pytest.raises(RuntimeError, match="lost"):
        job.on_batch(last, 2)
    monkeypatch.undo()
    for _ in range(2):
        job.on_batch(last, 2)
        assert tables(spark, job) == before


def test_revision_gets_its_own_card(spark):
    folder = job_folder(spark, "refresh")
    landed = spark.createDataFrame([tuple(e.values()) for e in ENTRIES[:1] + ENTRIES[5:7]], ENTRY)
    jobs = []
    arrivals(landed, F.col("arrival"), 2, f"{folder}/in", lambda s: jobs.append(refresh.refresh_stream(s, folder, RULES, brief)))
    first, second = sorted(tables(spark, jobs[-1])["cards"], key=lambda c: c["batch"])
    assert second["supersedes_card_id"] == first["id"] != second["id"] and first["supersedes_card_id"] is None


def test_nothing_landed(spark):
    job = refresh.Refresh(spark, job_folder(spark, "refresh"), RULES, brief)
    job.on_batch(spark.createDataFrame([], ENTRY).drop("arrival"), 0)
    assert job.runs.all().count() == 0

"""Keyed state over micro-batches against plain sequential models; a replayed batch changes nothing."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.operators.stories import WINDOW, headline_stories
from newsloom.streaming import jobs, keyed
from newsloom.streaming.state import BatchTable, arrivals, file_stream, job_folder, run_to_end

START = dt.datetime(2024, 1, 1)
DAY = 86_400_000_000


def _files(spark, folder, rows, schema, parts):
    size = len(rows) // parts + 1
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))


def _run(spark, rows, schema, job):
    """``rows`` end with their batch; the result after every batch has run."""
    folder, out = job_folder(spark, "t"), []
    df = spark.createDataFrame(rows, f"{schema}, arrival int")
    arrivals(df, F.col("arrival"), 1 + max(r[-1] for r in rows), f"{folder}/in", lambda s: out.append(job(s, folder)))
    return out[-1].collect()


@pytest.fixture(scope="module")
def late_rows():
    """(id, key, time, batch): 240 rows over 48 days in four batches of 12 days, every seventh a batch late."""
    rnd = random.Random(8)
    rows = []
    for i in range(240):
        at = START + dt.timedelta(microseconds=rnd.randint(0, 48 * DAY - 1))
        rows.append((i, f"h{rnd.randint(0, 4)}", at, min(3, (at - START).days // 12 + (i % 7 == 0))))
    return rows


def _t(at):
    return (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def _in_batches(rows):
    by_key = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[0])):
        by_key[r[1]].append(r)
    return by_key


def test_stories_with_late_cards(spark, late_rows):
    want = {}
    for own in _in_batches(late_rows).values():
        anchors = []
        for i, _, at, b in own:
            old = min(((t, a) for t, a, ab in anchors if ab < b and abs(t - _t(at)) <= WINDOW), default=None)
            fresh = [a for t, a, ab in anchors if ab == b and 0 <= _t(at) - t <= WINDOW]
            want[i] = old[1] if old else fresh[0] if fresh else i
            if want[i] == i:
                anchors.append((_t(at), i, b))
    got = _run(spark, late_rows, "id long, head string, published timestamp", lambda s, f: jobs.story_job(s, f, delay_days=30))
    assert {r["id"]: r["story"] for r in got} == want


def test_stories_over_batches_in_order_equal_one_batch(spark, late_rows):
    rows = [(i, h, at, (at - START).days // 12) for i, h, at, _ in late_rows]
    cards = spark.createDataFrame([(i, h, _t(at)) for i, h, at, _ in rows], "id long, head string, t long")
    whole = {r["id"]: r["story"] for r in headline_stories(cards).collect()}
    got = _run(spark, rows, "id long, head string, published timestamp", lambda s, f: jobs.story_job(s, f))
    assert {r["id"]: r["story"] for r in got} == whole


def test_rejections_with_late_entries(spark, late_rows):
    rows = [(i, k, i % 3 == 0, at, b) for i, k, at, b in late_rows] + [(999, None, None, START, 0)]
    want = {999}
    for own in _in_batches(late_rows).values():
        memory = None
        for i, _, at, _ in own:
            if memory is not None and memory >= _t(at) // DAY - 4:
                continue
            if i % 3 == 0:
                memory = _t(at) // DAY
            else:
                want.add(i)
    got = _run(spark, rows, "id long, key string, rejected boolean, published timestamp", lambda s, f: jobs.rejection_memory_job(s, f, days=4, delay_days=30))
    assert sorted(r["id"] for r in got) == sorted(want)


def test_versions_with_late_rows(spark, late_rows):
    rows = [(i, k, f"v{i % 9}", at, b) for i, k, at, b in late_rows]
    want, known = {}, defaultdict(dict)
    for b in range(4):
        fresh = defaultdict(dict)
        for i, k, v, at, batch in rows:
            if batch == b and v not in known[k]:
                fresh[k][v] = max(fresh[k].get(v, (_t(at), -i)), (_t(at), -i))
        for k, found in fresh.items():
            latest = max(known[k].values())[1] if known[k] else None
            for v, (t, i) in found.items():
                want[-i] = latest
            known[k] |= {v: (t, -i) for v, (t, i) in found.items()}
    got = _run(spark, rows, "id long, entry_id string, fingerprint string, published timestamp", lambda s, f: jobs.new_versions_job(s, f, delay_days=30))
    assert {r["id"]: r["revision_of"] for r in got} == want


def test_state_stays_flat(spark, tmp_path):
    """One new headline, one rejected id and one version a day, for forty days: memory holds what its window needs."""
    shapes = {
        "head string": (keyed.StoryAnchors(3 * DAY), "id long, story long"),
        "key string, rejected boolean": (keyed.RejectionMemory(3), "id long"),
        "entry_id string, fingerprint string": (keyed.VersionMemory(3), "id long, fingerprint string, t long, revision_of long"),
    }
    for n, (extra, (processor, out)) in enumerate(shapes.items()):
        names = [c.split()[0] for c in extra.split(", ")]
        folder = job_folder(spark, f"flat{n}")
        data = spark.range(40).select(
            "id", *[F.lit(True).alias(c) if c == "rejected" else F.concat(F.lit("k"), F.col("id")).alias(c) for c in names], (F.lit(START) + F.make_dt_interval(days=F.col("id").cast("int"))).alias("published")
        )
        data = data.withColumn("t", F.unix_micros("published"))
        sizes = []

        def start(stream, names=names, processor=processor, out=out, folder=folder, sizes=sizes):
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
            state = stream.withWatermark("published", "1 day").groupBy(names[0]).transformWithStateInPandas(processor, out, "append", "EventTime")
            query = state.writeStream.option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

        arrivals(data, F.floor(F.col("id") / 10), 4, f"{folder}/in", start)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        assert max(sizes) <= 2 * min(sizes) and sizes[-1] <= sizes[1], (extra, sizes)


def test_revisions(spark):
    rows = [("a", "x", 1, 0), ("b", "x", 2, 0), ("a", "x", 3, 0), ("b", "y", 4, 1), ("b", None, 5, 1), ("b", "y", 6, 1), (None, "z", 7, 1), ("c", None, 8, 0), ("c", "q", 9, 1), ("a", "w", 10, 2)]
    got = {r["seq"]: (r["outcome"], r["previous"]) for r in _run(spark, rows, "article_id string, digest string, seq long", jobs.revision_job)}
    want = {1: ("new", None), 2: ("new", None), 3: ("duplicate", "x"), 4: ("changed", "x"), 5: ("invalid", "y"), 6: ("duplicate", "y"), 7: ("invalid", None), 8: ("invalid", None), 9: ("new", None), 10: ("changed", "x")}
    assert got == want


def test_ledger_writes_only_changed_keys(spark):
    folder = job_folder(spark, "ledger")
    rows = [(f"e{i}", "1", i, "approved", 0) for i in range(20)] + [("e3", "1", 50, "rejected", 1)]
    df = spark.createDataFrame(rows, "event_id string, revision string, seq long, status string, arrival int")
    out = []
    arrivals(df, F.col("arrival"), 2, f"{folder}/in", lambda s: out.append(jobs.review_job(spark, s, folder)))
    got = {r["event_id"]: r["status"] for r in out[-1].collect()}
    assert len(got) == 20 and got["e3"] == "rejected" and got["e4"] == "approved"
    assert BatchTable(spark, f"{folder}/latest", jobs.LATEST).all().count() == 21


def test_replayed_batch(spark):
    table = BatchTable(spark, job_folder(spark, "t"), jobs.LATEST)
    for n in (0, 1, 0):
        table.write(spark.createDataFrame([(f"e{n}", "1", "approved", n)], jobs.LATEST), n)
    assert sorted(r["event_id"] for r in table.all().collect()) == ["e0", "e1"] and table.before(1).count() == 1


def test_stream_dedupe_is_a_stream(spark, tmp_path):
    rows = [(i, f"e{i % 7}", f"v{i // 10}", START + dt.timedelta(hours=i)) for i in range(60)]
    schema = "event_id long, entry_id string, fingerprint string, published timestamp"
    _files(spark, tmp_path / "in", rows, schema, 3)
    s = file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame(rows[:1], schema).schema, 1)
    kept = jobs.distinct_version_stream(s, F.lit(START + dt.timedelta(days=2)))
    got = spark.read.parquet(run_to_end(kept, job_folder(spark, "t"))).collect()
    assert kept.isStreaming and len(got) == len({(r["entry_id"], r["fingerprint"]) for r in got}) > 0

"""Keys that share a bucket of a stream's state stay apart, and their state is kept by bucket, not by key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import jobs
from newsloom.streaming.state import arrivals, job_folder

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rows(monkeypatch):
    """(id, key, value, published, arrival): 120 keys and the null key in two buckets, values that repeat over arrivals."""
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    rnd = random.Random(3)
    keys = [None, "", *(f"k{i}" for i in range(120))]
    return [(2**60 + i, rnd.choice(keys), rnd.choice([None, "a", "b", "c"]), START + dt.timedelta(days=10 * (i % 3), minutes=i), i % 3) for i in range(900)]


def _run(spark, rows, schema, job):
    folder, out = job_folder(spark, "buckets"), []
    df = spark.createDataFrame(rows, f"{schema}, arrival int")
    arrivals(df, F.col("arrival"), 3, f"{folder}/in", lambda s: out.append(job(s, folder)))
    return out[-1].collect()


def test_versions(spark, rows):
    want, known = {}, {}
    for b in range(3):
        fresh = {}
        for i, k, v, at, batch in sorted(rows, key=lambda r: r[0]):
            if batch == b and v not in known.get(k, {}):
                fresh.setdefault(k, {})[v] = (at, i)
        for k, found in fresh.items():
            latest = max(known[k].values())[1] if known.get(k) else None
            want |= {i: (v, latest) for v, (_, i) in found.items()}
            known.setdefault(k, {}).update(found)
    got = _run(spark, rows, "id long, entry_id string, fingerprint string, published timestamp", lambda s, f: jobs.new_versions_job(s, f, delay_days=30))
    assert {r["id"]: (r["fingerprint"], r["revision_of"]) for r in got} == want and len(got) == len(want)


def test_rejections(spark, rows):
    want, memory = set(), {}
    for i, k, v, at, _ in sorted(rows, key=lambda r: (r[-1], r[0])):
        if k in memory and memory[k] + dt.timedelta(days=12) >= at.replace(hour=0, minute=0):
            continue
        if v == "a":
            memory[k] = at.replace(hour=0, minute=0)
        else:
            want.add(i)
    got = _run(spark, [(i, k, v == "a", at, b) for i, k, v, at, b in rows], "id long, key string, rejected boolean, published timestamp", lambda s, f: jobs.rejection_memory_job(s, f, days=12, delay_days=30))
    assert sorted(r["id"] for r in got) == sorted(want)

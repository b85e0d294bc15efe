"""Registered queries against their SQL, and the pipeline against its stages' promises."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check_queries
import corpus_pipeline
from newsloom.llm import decontaminate, minhash, queries
from test_suffix_dedup import removal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables not present")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    text, _, ok = check_queries.compare(spark, con, name, SF)
    assert ok, text


def test_every_operator_and_the_pipeline():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name == "packing":
            break
        assert docs.columns == before.columns
        own = {r["doc_id"]: r for r in docs.collect()}
        prior = {r["doc_id"]: r["text"] for r in before.collect()}
        assert set(own) <= set(prior)
        if name in ("quality_rules", "near_dedup"):
            assert all(own[i]["text"] == prior[i] for i in own) and len(own) < len(prior)
        else:
            assert set(own) == set(prior) and all(r["n_chars"] == len(r["text"]) for r in own.values())
        if name == "near_dedup":
            assert minhash.near_duplicates(docs).filter("NOT kept").count() == 0
        if name == "substring_dedup":
            want = removal(list(prior.items()))
            assert all(own[i]["text"] == want[i, t.encode()][3].decode("utf-8", "ignore") for i, t in prior.items())
        if name == "decontamination":
            assert decontaminate.contamination(before, items).filter("contaminated").count() > 0
    assert docs.count() == before.count() and docs.filter("slot = 0 AND batch = 0").count() >= 1

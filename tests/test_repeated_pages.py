"""Queries over pages whose URLs repeat and whose titles hold odd entities, next to their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def pages_dir(spark, tmp_path_factory):
    titles = ["a &amp;&amp;&amp", "say &quot;x&quot; &#65; &nbsp;", " \t two\n lines\f ", "v\x0bt", "&amp;lt;b&lt;", "<i>in</i>", "no break"]
    rows = [(i, f"https://x.example/{i % 9}?utm_source=feed", f"<head><title>{titles[i % len(titles)]}</title><meta property='og:title' content='other'></head>") for i in range(60)]
    rows += [(60, "https://x.example/0", "<TITLE>upper</TITLE>"), (61, "https://x.example/0", "<title>open"), (62, "https://x.example/0", None), (63, "https://x.example/0", "")]
    folder = tmp_path_factory.mktemp("pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["assembled_feed", "intake_report", "page_titles"])
def test_repeated_pages(spark, pages_dir, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{pages_dir}/pages.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, pages_dir).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))

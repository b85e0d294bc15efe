"""Capture queries over blank, missing and repeated rows, next to their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def documents_dir(spark, tmp_path_factory):
    texts = ["", " \n\t ", None, "x", "x" * 150, "x" * 149 + "\xa0", "　" + "y" * 399, " \x0b" + "z" * 142, "a b\t\n\n\n\n" * 60, "x" * 400]
    rows = [(10 * i + j, text) for i, text in enumerate(texts) for j in range(10)]
    rows += [(7, "x" * 500), (7, ""), (7, "x" * 200), (7, "x" * 200), (12, None), (12, "y" * 160), (None, "x" * 300), (None, None), (None, "")]
    folder = tmp_path_factory.mktemp("documents")
    data = [(i, text, "en", "src1", len(text or "")) for i, text in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["captures_applied", "capture_outcomes"])
def test_odd_captures(spark, documents_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{documents_dir}/documents.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, documents_dir).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_one_blank_text(spark, tmp_path):
    """A single empty text is a short capture, as in the SQL."""
    spark.createDataFrame([(1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["captures_applied"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("1", "partial", "metadata_only", False)]


def test_texts_are_not_ranked(spark, monkeypatch):
    """Captures are put in order by what was read from their texts, without these."""
    from newsloom.operators import corpus, skew

    written, cut = [], skew.cut
    monkeypatch.setattr(skew, "cut", lambda df, *more: written.append(df.columns) or cut(df, *more))
    records = spark.createDataFrame([("a", "accessible", "full_text", None, None)], "article_id string, access_status string, evidence_scope string, evidence_hash string, evidence_local_ref string")
    captures = spark.createDataFrame([("a", i, "x" * 200 * i, None, False, None) for i in (1, 2)], "article_id string, seq int, text string, mode string, gated boolean, access_status string")
    updated, outcomes = corpus.apply_captures(records, captures, "store")
    assert [r["evidence_scope"] for r in updated.collect()] == ["full_text"]
    assert [r["outcome"] for r in outcomes.orderBy("seq").collect()] == ["applied", "corrected"]
    assert written and all("text" not in columns for columns in written)

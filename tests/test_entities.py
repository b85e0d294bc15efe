"""The entity index against whole-word patterns in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators.entity_index import NAMES, with_entities

DIMS = [
    {"canonical_id": "apex", "aliases": ["Apex"], "parent": "root"},
    {"canonical_id": "apex_income", "aliases": ["Apex Income Fund", "Apex Income Fund Corp."], "parent": "apex"},
    {"canonical_id": "nb", "aliases": ["NB"], "legacy_names": ["Northern Bank"], "ambiguity_rules": ["ER07"], "official_domains": ["nb.example"]},
    {"canonical_id": "tick", "aliases": ["Tick Holdings"], "ticker": {"symbol": "TCK", "exchange": "NYSE"}, "parent": "root"},
    {"canonical_id": "owl", "aliases": ["Blue Owl", "C++ Blue"], "excluded_contexts": ["awards", "zoo"]},
    {"canonical_id": "acc", "aliases": ["Élan Société"]},
]
URL = "https://n.example/"


def found(spark, rows, dims=DIMS):
    df = spark.createDataFrame(rows, "id long, x string, u string")
    return {r["id"]: [m.asDict() for m in r["entity_matches"]] for r in with_entities(df, "id", "x", "u", dims).collect()}


def statuses(hits):
    return {h["canonical_id"]: h["status"] for h in hits}


def test_rules(spark):
    got = found(
        spark,
        [
            (1, "Apex Income Fund closes. NB wins a match. TCK shares rose.", URL), (2, "NB wins.", "https://www.nb.example/a"), (3, "NB wins.", "https://nb.example.evil.example/a"),
            (4, "Northern bank wins", URL), (5, "NB grew its LENDING. Other.", URL), (6, "Other lending. NB wins. More.", URL), (7, "TCK fell. NYSE closed.", URL), (8, "tck shares", URL),
            (9, "Blue owl collected awards.", URL), (10, "Blue  Owl flew; blue-owl too; BlueOwl", URL), (11, "\U0001f600 ÉLAN SOCIÉTÉ and xC++ blue or C++ Blue", URL), (12, None, URL), (13, "", None), (14, "Apexes Apex_", URL),
            (15, "Apex Income Fund Corp. and Tick Holdings TCK", None),
        ],
    )
    assert statuses(got[1]) == {"apex": "suppressed_by_longer_name", "apex_income": "resolved", "nb": "ambiguous", "tick": "resolved"}
    assert [statuses(got[i]).get("nb") for i in (2, 3, 4, 5, 6)] == ["resolved", "ambiguous", "resolved", "resolved", "ambiguous"]
    assert statuses(got[7]) == {"tick": "ambiguous"} and got[8] == []
    assert got[9][0]["status"] == "excluded" and got[9][0]["excluded_context"] == ["awards"]
    assert got[10] == got[12] == got[13] == got[14] == []
    assert [(h["canonical_id"], h["matched_text"], h["start"], h["end"]) for h in got[11]] == [("owl", "C++ Blue", 32, 40), ("acc", "ÉLAN SOCIÉTÉ", 2, 14)]
    assert [(h["canonical_id"], h["rule"], h["parent"], h["matched_text"]) for h in got[15]] == [("apex", "ER01", "root", "Apex"), ("apex_income", "ER01", "apex", "Apex Income Fund Corp."), ("tick", "ER01", "root", "Tick Holdings")]
    assert got[1][0]["suppressed_by"] == "apex_income" and got[1][3]["rule"] == "ER04" and got[1][3]["parent"] is None


def test_spans_by_patterns(spark):
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma", "Delta", "x1", "été"]
    dims = [{"canonical_id": str(n), "aliases": [" ".join(rnd.choices(words, k=rnd.randint(1, 4)))]} for n in range(40)]
    texts = ["".join(rnd.choice(words).title() + rnd.choice([" ", " ", " ", "-", ". ", ""]) for _ in range(30)) for _ in range(40)]
    got = found(spark, [(i, t, URL) for i, t in enumerate(texts)], dims)
    for i, t in enumerate(texts):
        spans = {}
        for d in dims:
            m = re.search(rf"(?<!\w){re.escape(d['aliases'][0])}(?!\w)", t, re.IGNORECASE)
            if m:
                spans[d["canonical_id"]] = m.span()
        assert {h["canonical_id"]: (h["start"], h["end"]) for h in got[i]} == spans
        for h in got[i]:
            a, b = spans[h["canonical_id"]]
            over = [k for k, (c, d) in spans.items() if c <= a and b <= d and d - c > b - a]
            assert h["suppressed_by"] == (over[0] if over else None)


@pytest.mark.parametrize("copies", [300])
def test_large_dictionary(spark, copies):
    """100,000 names, a third of all texts naming the same one."""
    name = F.concat_ws(" ", F.concat(F.lit("name"), F.col("id") % 1000), F.concat(F.lit("of"), F.col("id")))
    dims = spark.range(100_000).select(
        F.col("id").cast("string").alias("entity"), F.col("id").alias("entity_place"), F.lit("name").alias("kind"), F.lit(0).cast("long").alias("place"), name.alias("name"), F.lit(False).alias("conditional"),
        F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("domains"), F.lit("").alias("exchange"),
    )
    assert [f.name for f in dims.schema] == NAMES.fieldNames()
    n = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 331)
    docs = spark.range(copies).select("id", F.concat(F.lit("today Name"), n % 1000, F.lit(" OF"), n, F.lit(" and name5 too")).alias("x"), F.lit(URL).alias("u"))
    rows = with_entities(docs, "id", "x", "u", dims).collect()
    assert all([h["canonical_id"] for h in r["entity_matches"]] == [str(7 if r["id"] % 3 == 0 else r["id"] * 331)] for r in rows) and len(rows) == copies



def test_a_text_is_read_once_per_name(spark):
    """However many names and phrases are found, no array of places is worked out again for each of them."""
    many = [{"canonical_id": f"e{i}", "aliases": [f"Name{i}"], "excluded_contexts": ["zoo"] if i % 3 else [], "ambiguity_rules": ["ER07"] if i % 2 else []} for i in range(6)]
    df = spark.createDataFrame([(1, " ".join(f"Name{i} lending." for i in range(6)) + " zoo", URL)], "id long, x string, u string")
    out = with_entities(df, "id", "x", "u", many)
    assert statuses([m.asDict() for m in out.collect()[0]["entity_matches"]]) == {f"e{i}": "excluded" if i % 3 else "resolved" for i in range(6)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(?<=[.!?])") == 1

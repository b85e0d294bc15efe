import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import packing, quality


def padding(tops, lengths):
    return sum(min(t for t in tops if t >= n) - n for n in lengths)


def test_quality_counts(nasty):
    rows = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality.quality(nasty).collect()}
    assert len(rows) == nasty.select("doc_id", "text").distinct().count()
    repeated = next(r for r in rows.values() if r["doc_id"] == 20)
    assert (repeated["n_dup_lines"], repeated["n_repeat_words"], repeated["base_failed"]) == (1, 6, True)
    assert all(not r["kept"] for r in rows.values() if r["n_words"] < 50)
    assert next(r for r in rows.values() if r["doc_id"] == 1)["kept"]
    assert next(r for r in rows.values() if r["doc_id"] == 22)["n_symbols"] == 6


def test_repeated_words_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in rng.integers(0, 30, 80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measure(df).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + o for k, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
        assert got[i] == len(hit), t


def test_keep_good_returns_the_columns(nasty, nothing):
    out = quality.keep_good(nasty)
    assert out.schema == nasty.schema and 1 in {r["doc_id"] for r in out.collect()}
    assert quality.keep_good(nothing).count() == 0 and quality.quality(nothing).count() == 0


def test_keep_good_agrees_with_quality(spark, nasty):
    rng = np.random.default_rng(5)
    words = "the of and to in house tree - * river ... ! walks".split()
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(1, 20))) for _ in range(rng.integers(1, 14))) for _ in range(60)]
    df = nasty.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = sorted(str(r["doc_id"]) for r in quality.quality(df).filter("kept").collect())
    assert sorted(str(r["doc_id"]) for r in quality.keep_good(df).collect()) == want and len(want) > 3


def test_repeated_lines_count_by_characters_from_six_lines_on(spark):
    own = [f"The house number {k} of the street in the town is for the man with a {w} hat and to be seen by us" for k, w in enumerate("red blue green white black grey".split())]
    texts = {1: [own[0], own[1], own[2], own[0]], 2: [*own, "Reply", "Reply", "Reply"], 3: [own[0], own[1], own[2]] + [own[3]] * 4}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert (got[1]["n_dup_lines"], got[1]["failed_rules"]) == (1, "")
    assert (got[2]["n_dup_lines"], got[2]["failed_rules"], got[2]["dup_line_chars"]) == (2, "", 10)
    assert got[3]["failed_rules"] == "duplicate_lines"


def test_own_rules(nasty):
    out = quality.quality(nasty, rules=[quality.Rule("short", "mean_word_length", None, 1.0)])
    assert {r["failed_rules"] for r in out.filter("n_words > 50").collect()} == {"short"}
    assert quality.quality(nasty, rules=[]).filter("NOT base_failed AND NOT kept").count() == 0


def test_bucket_tops_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 40, rng.integers(1, 12))
        values, counts = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3):
            from itertools import combinations

            tops = packing.optimal_tops(counts, counts * values, values, k)
            best = min(padding({*c, values[-1]}, lengths) for r in range(k) for c in combinations(values[:-1].tolist(), r))
            assert padding(tops, lengths) == best and tops[-1] == values[-1]


def test_batches(spark, nasty, nothing):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") * 37).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")).alias("text"))
    rows = packing.pack(docs, budget=200, buckets=4).collect()
    assert len(rows) == 3000
    by = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_len"]
        by.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), own in by.items():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) * own[0]["bucket_len"] <= 200 or len(own) == 1
        if (bucket, batch + 1) in by:  # only the last batch of a bucket may be short
            assert len(own) == max(1, 200 // max(1, own[0]["bucket_len"]))
    assert packing.pack(nasty).count() == nasty.count()
    assert packing.pack(nothing).count() == 0

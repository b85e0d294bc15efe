"""Cards at reviewed anchors against all pairs, with one head that holds most of both sides."""

import random

from newsloom.operators import stories


def test_hits_by_all_pairs(spark, careful):
    rnd = random.Random(6)
    head = lambda: "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
    cards = [(i, head(), rnd.randint(0, 400)) for i in range(300)]
    anchors = [(head(), rnd.randint(0, 400), 1000 + i, f"s{i}") for i in range(25)]
    want = {}
    for i, h, t in cards:
        near = sorted((at, aid, s) for ah, at, aid, s in anchors if h is not None and ah == h and abs(at - t) <= 7)
        if near:
            want[i] = near[0][2]
    got = stories.reviewed_anchor_hits(spark.createDataFrame(cards, "id long, head string, t long"), spark.createDataFrame(anchors, "head string, t long, id long, story string"), 7)
    rows = got.collect()
    assert {r["id"]: r["story"] for r in rows} == want and len(rows) == len(want)
    none = spark.createDataFrame([], "head string, t long, id long, story string")
    assert stories.reviewed_anchor_hits(spark.createDataFrame(cards, "id long, head string, t long"), none, 7).count() == 0


def test_followers_by_all_pairs_in_one_pass(spark):
    rnd = random.Random(8)
    times = sorted({(rnd.choice("ab"), rnd.choice([rnd.randint(-50, 90), rnd.randint(300, 330), 7 * rnd.randint(0, 9)])) for _ in range(200)})
    out = stories._followers(spark.createDataFrame(times, "head string, t long"), 7)
    assert {(r["head"], r["t"]): r["next"] for r in out.collect()} == {(h, t): min((u for g, u in times if g == h and u > t + 7), default=None) for h, t in times}
    # A frame that ends unbounded is run through again for every row: quadratic in a head's rows of a week.
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()

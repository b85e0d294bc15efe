"""Randomised comparison of the distributed algorithms with tiny sequential models of the rules."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from newsloom.operators import clusters, matching, scoring, skew, stories
from newsloom.operators.components import connected_components

DAY = 86_400_000_000


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- joins and ranks -------------------------------------------------------------------------
def test_hot_keys_join_like_any_other(spark, careful):
    data = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)]
    df = spark.createDataFrame(data, "id int, k string")
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = {(r["id"], r["k"], r["n"], r["low"]) for r in rows(skew.attach_per_key(df, per, ["k"], "n"))}
    n = {k: [i for i, x in data if x == k] for _, k in data}
    assert got == {(i, k, len(n[k]), min(n[k])) for i, k in data}
    only = skew.attach_per_key(df, per.filter("n > 50"), ["k"], "n", how="inner")
    assert only.count() == 200


def test_distributed_rank_equals_sort(spark, careful):
    rnd = random.Random(3)
    data = [(f"s{rnd.choice([0, 0, 0, 1, 2])}", rnd.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(data, "s string, v int, id int")
    got = {(r["s"], r["id"]): r["rank"] for r in rows(skew.rank_all(df, [F.col("v").desc(), F.col("id")], ["s"]))}
    for s in {d[0] for d in data}:
        ordered = sorted((d for d in data if d[0] == s), key=lambda d: (-d[1], d[2]))
        assert [got[(s, d[2])] for d in ordered] == list(range(1, len(ordered) + 1))
    whole = {r["id"]: r["rank"] for r in rows(skew.rank_all(df, [F.col("v").desc(), F.col("id")]))}
    assert [whole[d[2]] for d in sorted(data, key=lambda d: (-d[1], d[2]))] == list(range(1, 401))


def test_running_helpers_over_many_blocks(spark, careful):
    df = spark.createDataFrame([("a", i, (i * 7) % 5) for i in range(20)], "s string, pos int, v int")
    got = {r["pos"]: r["out"] for r in rows(skew.running_sum(df, ["s"], "pos", "v", "out"))}
    assert got == {i: sum((j * 7) % 5 for j in range(i)) for i in range(20)}
    prev = {r["pos"]: r["out"] for r in rows(skew.previous_value(df, ["s"], [F.col("pos")], "v", "out"))}
    assert prev == {i: ((i - 1) * 7) % 5 if i else None for i in range(20)}


# --- components ------------------------------------------------------------------------------
def _roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_components_of_chains_stars_and_random_graphs(spark):
    rnd = random.Random(5)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(64)]
    rnd.shuffle(chain)
    star = [("s999", f"s{i:03d}") for i in range(50)]
    noise = [(f"n{rnd.randint(0, 80):03d}", f"n{rnd.randint(0, 80):03d}") for _ in range(60)]
    edges = chain + star + noise
    got = {r["node"]: r["root"] for r in rows(connected_components(spark.createDataFrame(edges, "a string, b string")))}
    expected = _roots([e for e in edges if e[0] != e[1]])
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_with_hot_nodes(spark, careful):
    edges = [("s999", f"s{i:03d}") for i in range(30)] + [("a", "b"), ("b", "c")]
    got = {r["node"]: r["root"] for r in rows(connected_components(spark.createDataFrame(edges, "a string, b string")))}
    assert got == _roots(edges)


# --- clusters --------------------------------------------------------------------------------
def _relation(x, y):
    """(identical, linked, unclear) of two articles, from what they share."""
    shares = lambda *fields: any(x[f] and x[f] == y[f] for f in fields)
    identical = shares("url", "hash")
    block = shares("type") and not set(x["parties"]).isdisjoint(y["parties"])
    vehicle_missing = not (x["vehicle"] and y["vehicle"])
    chained = x["id"] == y["sup"] or y["id"] == x["sup"]
    linked = identical or chained or (block and (shares("vehicle") or (vehicle_missing and shares("period", "date"))))
    return identical, linked, block and vehicle_missing and not linked


def test_clusters_equal_the_pairwise_rule(spark):
    rnd = random.Random(11)
    arts = []
    for i in range(90):
        arts.append(
            {
                "id": f"a{i:03d}", "url": rnd.choice([None, None, None, f"u{rnd.randint(0, 30)}"]), "hash": rnd.choice([None, None, f"h{rnd.randint(0, 60)}"]),
                "sup": rnd.choice([None] * 12 + [f"a{rnd.randint(0, 89):03d}"]), "type": rnd.choice("xyz"), "parties": rnd.sample([f"p{j}" for j in range(9)], rnd.randint(0, 2)),
                "vehicle": rnd.choice(["", f"v{rnd.randint(0, 9)}"]), "period": rnd.choice(["", "", f"q{rnd.randint(0, 9)}"]), "date": rnd.choice(["", "", f"d{rnd.randint(0, 9)}"]),
            }
        )
    profile = spark.createDataFrame(
        [(a["id"], a["type"], a["parties"], a["vehicle"], a["period"], a["date"], a["url"], a["hash"], a["sup"]) for a in arts],
        "article_id string, type string, parties array<string>, vehicle string, period string, event_date string, canonical_url string, evidence_hash string, supersedes_article_id string",
    )
    relations = {(x["id"], y["id"]): _relation(x, y) for i, x in enumerate(arts) for y in arts[i + 1 :]}
    root = {a["id"]: a["id"] for a in arts} | _roots([p for p, (_, linked, _) in relations.items() if linked])
    members = clusters.cluster_members(profile)
    assert {r["article_id"]: r["root"] for r in rows(members)} == root
    partners = defaultdict(set)
    for (x, y), (_, _, unclear) in relations.items():
        if unclear and root[x] != root[y]:
            partners[root[x]].add(y)
            partners[root[y]].add(x)
    assert {r["root"] for r in rows(clusters.ambiguous_roots(profile, members))} == set(partners)
    listed = defaultdict(set)
    for r in rows(clusters.ambiguous_partners(profile, members, members)):
        listed[r["root"]].add(r["article_id"])
    assert listed == partners
    doubled = {p for pair, (identical, _, _) in relations.items() if identical for p in pair}
    assert {r["article_id"] for r in rows(clusters.duplicates(profile, members))} == {d for d in doubled if root[d] != d}
    big = clusters.cluster_ids(members)
    assert big.select("cluster_id").distinct().count() == len(set(root.values()))


# --- stories ---------------------------------------------------------------------------------
def _check_stories(got, cards, reviewed, window):
    """A card follows the first anchor of its head within the window: reviewed ones first, then cards up to itself that
    opened a story; so it opens one itself exactly when no other is near."""
    fixed = sorted((r["t"], r["id"], r["story"], r["head"]) for r in reviewed)
    opened = sorted((c["t"], c["id"], c["id"], c["head"]) for c in cards if got[c["id"]] == c["id"])
    for c in cards:
        earlier = [a for a in opened if a[:2] <= (c["t"], c["id"])]
        near = [story for t, _, story, head in fixed + earlier if head == c["head"] and abs(t - c["t"]) <= window]
        assert got[c["id"]] == (near[0] if near else None), c


def test_stories_follow_the_first_near_anchor(spark):
    rnd = random.Random(2)
    cards = [{"id": f"c{i:04d}", "head": f"h{rnd.randint(0, 12)}", "t": rnd.randint(0, 60) * DAY + rnd.choice([0, 0, 1])} for i in range(500)]
    reviewed = [{"id": f"r{i}", "head": f"h{i % 6}", "t": rnd.randint(0, 60) * DAY, "story": f"rev{i}"} for i in range(14)]
    df = spark.createDataFrame([(c["id"], c["head"], c["t"]) for c in cards], "id string, head string, t long")
    rv = spark.createDataFrame([(r["id"], r["head"], r["t"], r["story"]) for r in reviewed], "id string, head string, t long, story string")
    got = lambda *a: {r["id"]: r["story"] for r in rows(stories.headline_stories(df, *a))}
    _check_stories(got(), cards, [], 7 * DAY)
    _check_stories(got(rv), cards, reviewed, 7 * DAY)


# --- ordering --------------------------------------------------------------------------------
def _decisions(rnd, n):
    out = []
    for i in range(n):
        score = rnd.choice([None, 60, 62, 66, 70, 74, 75, 80, 84])
        rec = "shortlist" if (score or 0) >= 70 else "reserve_manual_only"
        crit = rnd.random() < 0.15
        out.append({"event_id": f"e{i:02d}", "total_score": score, "recommendation": rnd.choice([rec, rec, "review_required"]), "primary_region": rnd.choice(["Europe", "US"]), "crit": crit})
    return out


def _base(ds):
    return sorted(ds, key=lambda d: (not d["crit"], -(d["total_score"] or 0), d["event_id"]))


def _passes(held, d):
    close = (held["total_score"] or 0) <= (d["total_score"] or 0) + 5
    return close and held["recommendation"] == d["recommendation"] and not held["crit"] and not d["crit"] and (held["primary_region"], d["primary_region"]) == ("US", "Europe")


def _swapped(ds):
    """One pass that holds an event in hand and lets Europeans go by."""
    out, held = [], None
    for d in _base(ds):
        if held is not None and _passes(held, d):
            out.append(d)
        else:
            out += [held] if held else []
            held = d
    return out + ([held] if held else [])


def _slots(order, cap=10):
    """Listed events are selected up to the cap, critical ones beyond it too; of the rest, critical ones are urgent."""
    listed = [d["recommendation"] in ("shortlist", "priority_shortlist") for d in order]
    name = lambda i, d: ("selected" if d["crit"] or sum(listed[:i]) < cap else "overflow") if listed[i] else ("urgent_review" if d["crit"] else "none")
    return {d["event_id"]: name(i, d) for i, d in enumerate(order)}


def _frame(spark, groups):
    data = [
        (s, d["event_id"], d["total_score"], d["recommendation"], d["primary_region"], ["critical_review"] if d["crit"] else ["x"]) for s, ds in groups.items() for d in ds
    ]
    return spark.createDataFrame(data, "s int, event_id string, total_score int, recommendation string, primary_region string, disposition_reason_codes array<string>")


def test_tie_break_and_selection_equal_the_sequential_pass(spark, careful):
    rnd = random.Random(9)
    groups = {seed: _decisions(rnd, rnd.randint(0, 30)) for seed in range(60)}
    ranked = scoring.rank_decisions(_frame(spark, groups), ["s"])
    got = rows(scoring.select_edition(ranked, ["s"], capacity=3))
    position = {(r["s"], r["event_id"]): r["position"] for r in got}
    slot = {(r["s"], r["event_id"]): r["slot"] for r in got}
    for s, ds in groups.items():
        order = _swapped(ds)
        assert [position[(s, d["event_id"])] for d in order] == list(range(1, len(order) + 1)), s
        assert {e: slot[(s, e)] for e in _slots(order, 3)} == _slots(order, 3), s


def test_editions_roll_their_history_forward(spark):
    rnd = random.Random(21)
    groups = {day: _decisions(rnd, rnd.randint(1, 25)) for day in range(40)}
    for day, ds in groups.items():
        for d in ds:
            d["event_id"] = f"{day}-{d['event_id']}"
    got = {r["event_id"]: (r["position"], r["slot"]) for r in rows(scoring.editions_by_day(_frame(spark, groups), "s"))}
    history = []
    for day in sorted(groups):
        share = history.count("Europe") / len(history) if history else 0.0
        order = _base(groups[day]) if share >= 0.2 else _swapped(groups[day])
        slots = _slots(order)
        assert [got[d["event_id"]] for d in order] == [(i + 1, slots[d["event_id"]]) for i, d in enumerate(order)], day
        history += [d["primary_region"] for d in order if slots[d["event_id"]] == "selected"]


# --- matching --------------------------------------------------------------------------------
def test_greedy_matching_equals_the_sequential_greedy(spark):
    rnd = random.Random(4)
    pairs = sorted({(-rnd.randint(1, 4), f"e{rnd.randint(0, 25):02d}", f"g{rnd.randint(0, 25):02d}") for _ in range(160)})
    seen, unique = set(), []
    for o, e, g in pairs:
        if (e, g) not in seen:
            seen.add((e, g))
            unique.append((o, e, g))
    taken, used = [], set()
    for o, e, g in unique:
        if e not in used and g not in used:
            taken.append((e, g))
            used |= {e, g}
    df = spark.createDataFrame(unique, "o int, e string, g string")
    assert {(r["e"], r["g"]) for r in rows(matching.greedy_pairs(df, "e", "g", ["o", "e", "g"]))} == set(taken)


def test_links_act_in_time_order(spark):
    import random

    from newsloom.operators.events import _follow_links

    def in_order(links):
        label = {k: k for a, b, _, _ in links for k in (a, b)}
        for a, b, _, _ in sorted(links, key=lambda x: (x[2], x[3])):
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
        return label

    rng = random.Random(3)
    cases = [[("A", "B", "1", "x"), ("A", "reviewed|C", "2", "y"), ("D", "B", "3", "z")], [("A", "B", "1", "x"), ("B", "A", "2", "y")]]
    for k in range(6):
        names = [f"{k}n{i}" for i in range(8)]
        cases.append([(*rng.sample(names, 2), str(rng.randrange(4)), f"c{i}") for i in range(12)])
    merged = [tuple(f"{k}:{x}" if i < 2 else x for i, x in enumerate(link)) for k, case in enumerate(cases) for link in case]
    got = {r["bucket"]: r["final"] for r in rows(_follow_links(spark.createDataFrame(merged, "a string, b string, at string, cid string")))}
    want = {}
    for k, case in enumerate(cases):
        want |= in_order([tuple(f"{k}:{x}" if i < 2 else x for i, x in enumerate(link)) for link in case])
    assert got == want
    assert got["0:A"] == "0:reviewed|C" == got["0:D"] and got["1:A"] == "1:B"


def test_fallback_ids_never_collide(spark):
    from newsloom.operators.events import carry_event_ids

    buckets = spark.createDataFrame([("X", 1, "1"), ("Y", 2, "5")], "bucket string, first_t long, first_id string")
    members = spark.createDataFrame([("X", "1", 1), ("Y", "5", 2)], "bucket string, id string, t long")
    prior = spark.createDataFrame([("1", "evt-5")], "id string, event_id string")
    none = spark.createDataFrame([], "event_id string")
    got = {r["bucket"]: r["event_id"] for r in rows(carry_event_ids(buckets, members, prior, none))}
    assert got["X"] == "evt-5" and got["Y"].startswith("evt-5-")


def test_null_scopes_keep_their_rows(spark, careful):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "s", i % 5) for i in range(40)], "id int, scope string, v int")
    ranked = skew.rank_all(df, [F.col("id")], ["scope"], "k", partitions=4)
    assert ranked.count() == 40 and {r["k"] for r in rows(ranked.filter("scope IS NULL"))} == set(range(1, 15))
    for made in (
        skew.running_max(ranked, ["scope"], "k", F.col("v"), "out"),
        skew.running_sum(ranked.withColumn("p", F.col("k") - 1), ["scope"], "p", "v", "out"),
        skew.previous_value(df, ["scope"], [F.col("id")], "v", "out"),
    ):
        got = {(r["id"], r["out"]) for r in rows(made)}
        assert len(got) == 40 and sum(x[1] is not None for x in got) >= 38


def test_long_chains_of_parents(spark):
    from newsloom.operators.baseline import ancestors

    edges = spark.createDataFrame([(f"e{i:03}", f"e{i + 1:03}") for i in range(80)], "entity string, parent string")
    got = rows(ancestors(edges).filter("entity = 'e000'"))
    assert {(r["ancestor"], r["depth"]) for r in got} == {(f"e{i:03}", i) for i in range(1, 81)}


def test_terms_of_any_length(spark):
    from newsloom.operators.rules import match_terms_by_join

    docs = spark.createDataFrame([(1, "one two three four five six")], "id int, text string")
    terms = spark.createDataFrame([("two three four five six",), ("one",)], "term string")
    assert {r["term"] for r in rows(match_terms_by_join(docs, terms, "id", "text"))} == {"two three four five six", "one"}


def test_partner_members_tell_every_pair(spark):
    """The blocks and their articles give the same (cluster, partner) pairs as the list of pairs."""
    rows = [(f"a{i}", f"r{i // 2}", "t" if i % 3 else "u", "v" if i % 4 == 1 else "", ["p", "q"] if i % 5 else ["q"]) for i in range(24)]
    given = spark.createDataFrame(rows, "article_id string, root string, type string, vehicle string, parties array<string>")
    profile, members = given.drop("root"), given.select("article_id", "root")
    told = clusters.partner_members(profile, members).collect()
    assert all(r["partners"] == len({y["article_id"] for y in told if (y["type"], y["party"]) == (r["type"], r["party"]) and y["root"] != r["root"] and (r["free"] or y["open"])}) for r in told)
    got = {(x["root"], y["article_id"]) for x in told for y in told if (x["type"], x["party"]) == (y["type"], y["party"]) and x["root"] != y["root"] and (x["free"] or y["open"])}
    assert got == {(r["root"], r["article_id"]) for r in clusters.ambiguous_partners(profile, members, members).collect()} and got

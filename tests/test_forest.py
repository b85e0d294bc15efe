"""Parent chains against plain walks."""

import json
import random

from newsloom.operators import validators
from newsloom.operators.forest import parent_forest, standing_above


def _above(parents, start):
    seen, at = set(), parents.get(start)
    while at is not None and at not in seen:
        seen.add(at)
        at = parents.get(at)
    return seen


def test_random_forests_with_rings(spark):
    dice = random.Random(4)
    names = [f"e{k:02d}" for k in range(40)]
    for ringed in (False, True):
        parents = {n: (dice.choice(names) if ringed else dice.choice([None, *names[:k]]) if k else None) for k, n in enumerate(names)}
        parents["e39"] = "outside"
        edges = spark.createDataFrame([*parents.items(), (None, "e01")], "entity string, parent string")
        forest = parent_forest(edges)
        pairs = spark.createDataFrame([(a, b) for a in [*names, "nobody"] for b in [*names, "outside"]] + [(None, "e01"), ("e01", None)], "low string, high string")
        got = {tuple(r) for r in standing_above(pairs, forest).collect()}
        assert got == {(a, b) for a in names for b in _above(parents, a)}


def test_an_empty_ontology_and_a_long_chain(spark):
    assert standing_above(spark.createDataFrame([("a", "b")], "low string, high string"), parent_forest(spark.createDataFrame([], "entity string, parent string"))).count() == 0
    n = 100_000
    chain = spark.range(n).selectExpr("cast(id as string) entity", f"if(id < {n - 1}, cast(id + 1 as string), null) parent")
    forest = parent_forest(chain)
    assert len(forest.jumps) <= 18
    pairs = spark.createDataFrame([("0", str(n - 1)), ("5", "4"), ("7", "7"), ("31", "77777"), ("77777", "31")], "low string, high string")
    assert {tuple(r) for r in standing_above(pairs, forest).collect()} == {("0", str(n - 1)), ("31", "77777")}


def test_classification_with_many_entities(spark):
    n = 20_000
    ontology = spark.range(n).selectExpr("cast(id as string) entity", "if(id > 0, cast(floor(id / 3) as string), null) parent")
    raw = lambda up: json.dumps({
        "primary_event_type": "x", "relevance_level": "A", "identity_gate": "pass", "direct_entity_ids": ["19999", "gone"], "propagated_entity_ids": up,
        "entity_matches": [{"entity_id": "19999", "economic_role": "manager", "involvement": "direct_involvement", "evidence_refs": ["1"]}],
    })
    df = spark.createDataFrame([("1", raw(["6666", "0"])), ("1", raw(["6665"])), ("1", None), ("1", raw(["6665"]))], "article_id string, raw string")
    out = validators.validate_classification(df, "raw", {"x": []}, [], [], ontology)
    assert out.columns == ["article_id", "raw", "errors"]
    got = [" ".join(r["errors"]) for r in out.collect()]
    assert len(got) == 4 and sum("unknown direct_entity_ids value gone" in g for g in got) == 3
    facts = {tuple(sorted(r["_reached"] or [])) for r in validators._ontology_facts(df.select("raw"), ontology).collect()}
    assert facts == {("0", "6666"), ()}

"""sameAs classes and names some edits apart, against plain versions."""

import random

from pyspark.sql import functions as F

from lattica.operators import alignment, sameas


def plain(edges):
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(label.items())


def test_classes(spark):
    r = random.Random(4)
    names = [f"n{i:03}" for i in range(120)]
    chain = r.sample([f"m{i:03}" for i in range(80)], 80)
    edges = [(r.choice(names), r.choice(names)) for _ in range(70)] + list(zip(chain, chain[1:])) + [("hub", n) for n in names[:20]]
    edges += [(None, "x"), ("x", None), ("y", "y"), ("y", "y"), edges[0]]
    got = sameas.classes(spark.createDataFrame(edges, "a string, b string"))
    assert sorted(map(tuple, got.collect())) == plain(edges)
    assert sameas.classes(spark.createDataFrame([], "a string, b string")).collect() == []


def test_names_some_edits_apart(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choices("ab文彭", k=r.randint(0, 5))) for _ in range(60)})
    people = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(names)] + [("p0", names[1]), ("px", None)], "node string, name string")
    external = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names[::2] + ["", None, "ab"])], "ext_id string, name string")
    for most in (0, 1, 2):
        got = alignment.match_names(people, external, most)
        edits = F.levenshtein(people["name"], external["name"])
        want = people.crossJoin(external).where(edits <= most).select("node", "ext_id", edits.alias("edits"))
        assert sorted(map(tuple, got.drop("method").collect())) == sorted(map(tuple, want.collect()))
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_facts_are_joined_once_for_graph_and_provenance(spark):
    facts = spark.createDataFrame([("1", "r", "b", "c", "iri"), ("2", "r", "x", "b", "iri"), ("3", "r", "x", "a", "iri")], "fact_id string, rel_type string, source string, target string, target_kind string")
    known = spark.createDataFrame([("b", "a"), ("a", "a")], "node string, canonical string")
    got = sameas.rewritten(facts, known)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    rows = sorted((r.fact_id, r.source, r.target, r.was_source, r.was_target, r.was_rewritten) for r in got.collect())
    assert rows == [("1", "a", "c", "b", "c", True), ("2", "x", "a", "x", "b", True), ("3", "x", "a", None, None, False)]

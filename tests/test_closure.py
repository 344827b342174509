"""Ways of one or more steps between two variables."""

import random

import pytest

from lattica.plans.graph import KnowledgeGraph
from lattica.plans.sparql import compiler, select
from lattica.plans.sparql.syntax import SparqlError
from lattica.sources.turtle import parse_turtle


def plain(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        todo, seen = list(after[a]), set(after[a])
        while todo:
            for c in after.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        out |= {(a, b) for b in seen}
    return out


def test_random_graphs_and_cycles(spark):
    r = random.Random(6)
    for n, m in ((12, 14), (30, 60)):
        edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)] + [("x", "x"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0")]
        got = compiler.doubled(spark.createDataFrame(edges, "s string, o string"))
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == plain(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    made, cut = [], compiler.cut
    monkeypatch.setattr(compiler, "cut", lambda df: made.append(1) or cut(df))
    n = 700
    got = compiler.doubled(spark.range(n).selectExpr("cast(id as string) as s", "cast(id + 1 as string) as o"))
    assert got.count() == n * (n + 1) // 2 and len(made) <= 12


@pytest.fixture(scope="module")
def numbers(spark):
    text = "@prefix : <urn:t:> . :a :v 1 . :b :v 1.0 . :c :v '1' . :d :v 2 . :e :v 'x'@en . :f :v 'x' . :g :v true . :p :w 1.00 . :q :w '1' . :r :w 'x'@EN . :s :w 3 . :u :w -0.0 . :h :v 0 ."
    return KnowledgeGraph.from_triples(spark.createDataFrame(parse_turtle(text), "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"))


def asked(kg, inside, negated=""):
    return sorted(r.x.removeprefix("urn:t:") for r in select(kg, f"PREFIX : <urn:t:> SELECT ?x {{ ?x :v ?n FILTER {negated} EXISTS {{ ?y :w ?m FILTER({inside}) }} }}").collect())


def test_equalities_of_exists_are_keys(numbers, monkeypatch):
    assert asked(numbers, "?m = ?n") == ["a", "b", "c", "e", "h"]
    assert asked(numbers, "?n = ?m", "NOT") == ["d", "f", "g"]
    assert asked(numbers, "?m + 1 = ?n + 1") == ["a", "b", "h"]
    assert asked(numbers, "STR(?m) = STR(?n)") == ["a", "c", "e", "f"]
    assert asked(numbers, "?m = ?n && ?m > 0") == ["a", "b"]
    assert asked(numbers, "STRLEN(STR(?m)) = ?n") == ["a", "b"]
    plan = select(numbers, "PREFIX : <urn:t:> SELECT ?x { ?x :v ?n FILTER EXISTS { ?y :w ?m FILTER(?m = ?n) } }")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert asked(numbers, "?m > ?n") == ["a", "b", "c", "d", "g", "h"]
    monkeypatch.setattr(compiler, "MOST_UNKEYED", 2)
    with pytest.raises(SparqlError, match="without an equality"):
        asked(numbers, "?m > ?n")
    assert asked(numbers, "?m = ?n") == ["a", "b", "c", "e", "h"]

"""Named graphs: GRAPH, FROM and FROM NAMED against a plain evaluation."""

import random

import pytest

from lattica.plans.dataset import Dataset, named
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import LABEL, TRIPLES, TYPE, Vocabulary
from lattica.plans.sparql import select
from lattica.plans.sparql.compiler import Compiler
from lattica.plans.sparql.syntax import SparqlError, parse
from lattica.sources.turtle import read_nquads

V = Vocabulary("urn:v#", "v")


def statement(s, p, o):
    return (s, "iri", p, o, "iri", None, None)


def dataset(spark, graphs):
    return Dataset.from_quads(named({g: spark.createDataFrame([statement(*t) for t in rows], TRIPLES) for g, rows in graphs.items()}), V)


def rows(data, text):
    return sorted(tuple(r) for r in select(data, f"{V.header()}\n{text}").collect())


@pytest.fixture(scope="module")
def random_graphs():
    r = random.Random(4)
    return {f"urn:g{i}": sorted({(f"urn:n{r.randrange(8)}", f"urn:{r.choice('pq')}", f"urn:n{r.randrange(8)}") for _ in range(14)}) for i in range(3)}


@pytest.fixture(scope="module")
def data(spark, random_graphs):
    return dataset(spark, random_graphs)


def reached(edges):
    found = set(edges)
    while more := {(a, d) for a, b in found for c, d in edges if b == c} - found:
        found |= more
    return found


def test_joins_and_paths_stay_within_a_graph(data, random_graphs):
    want, closed, zero = [], [], []
    for g, triples in random_graphs.items():
        p, q = ({(s, o) for s, x, o in triples if x == f"urn:{n}"} for n in "pq")
        want += [(g, a, d) for a, b in p for c, d in q if b == c]
        closed += [(g, a, b) for a, b in reached(p)]
        zero += [(g, b) for b in {"urn:n1"} | {b for a, b in reached(p) if a == "urn:n1"}]
    assert rows(data, "SELECT ?g ?a ?c WHERE { GRAPH ?g { ?a <urn:p> ?b . ?b <urn:q> ?c } }") == sorted(want)
    assert rows(data, "SELECT ?g ?a ?c WHERE { GRAPH ?g { ?a <urn:p>/<urn:q> ?c } }") == sorted(want)
    assert rows(data, "SELECT ?g ?a ?b WHERE { GRAPH ?g { ?a <urn:p>+ ?b } }") == sorted(closed)
    assert rows(data, "SELECT ?g ?b WHERE { GRAPH ?g { <urn:n1> <urn:p>* ?b } }") == sorted(zero)


def test_minus_exists_and_optional_within_a_graph(data, random_graphs):
    kept, seen, left = [], [], []
    for g, triples in random_graphs.items():
        p, q = ([(s, o) for s, x, o in triples if x == f"urn:{n}"] for n in "pq")
        kept += [(g, a) for a, _ in p if a not in {s for s, _ in q}]
        seen += [(g, a) for a, _ in p if a in {s for s, _ in q}]
        left += [(g, a, o) for a, _ in p for o in [d for c, d in q if c == a] or [""]]
    assert rows(data, "SELECT ?g ?a WHERE { GRAPH ?g { ?a <urn:p> ?b MINUS { ?a <urn:q> ?c } } }") == sorted(kept)
    assert rows(data, "SELECT ?g ?a WHERE { GRAPH ?g { ?a <urn:p> ?b FILTER EXISTS { ?a <urn:q> ?c } } }") == sorted(seen)
    assert rows(data, "SELECT ?g ?a ?o WHERE { GRAPH ?g { ?a <urn:p> ?b OPTIONAL { ?a <urn:q> ?o } } }") == sorted(left)
    # Parts that share no variable remove nothing, though they share the graph.
    every = sorted((g, s) for g, t in random_graphs.items() for s, p, _ in t if p == "urn:p")
    assert rows(data, "SELECT ?g ?a WHERE { GRAPH ?g { ?a <urn:p> ?b MINUS { ?c <urn:q> ?d } } }") == every


def test_names_and_clauses(data, random_graphs):
    of = lambda *gs: sorted({(s, o) for g in gs for s, p, o in random_graphs[g] if p == "urn:p"})
    body = "{ ?a <urn:p> ?b }"
    assert rows(data, f"SELECT ?a ?b WHERE {body}") == of(*random_graphs)
    assert rows(data, f"SELECT ?a ?b FROM <urn:g0> FROM <urn:g2> WHERE {body}") == of("urn:g0", "urn:g2")
    assert rows(data, f"SELECT ?a ?b FROM NAMED <urn:g0> WHERE {body}") == []
    assert rows(data, f"SELECT ?a ?b WHERE {{ GRAPH <urn:g1> {body} }}") == of("urn:g1")
    assert rows(data, f"SELECT ?a ?b FROM NAMED <urn:g0> WHERE {{ GRAPH <urn:g1> {body} }}") == []
    assert rows(data, f"SELECT * FROM NAMED <urn:g0> FROM NAMED <urn:none> WHERE {{ GRAPH ?g {body} }}") == [("urn:g0", *r) for r in of("urn:g0")]
    assert rows(data, "SELECT ?g WHERE { GRAPH ?g { } }") == [(g,) for g in sorted(random_graphs)]
    assert rows(data, "SELECT ?x WHERE { GRAPH <urn:none> { VALUES ?x { 1 } } }") == []
    assert rows(data, "SELECT ?g ?x WHERE { GRAPH ?g { VALUES (?g ?x) { (<urn:g1> 1) (UNDEF 2) } } }") == sorted([("urn:g1", "1")] + [(g, "2") for g in random_graphs])
    across = sorted((a, c) for a, b in of("urn:g0") for x, c in of("urn:g1") if x == b)
    assert rows(data, "SELECT ?a ?c WHERE { GRAPH <urn:g0> { ?a <urn:p> ?b } GRAPH <urn:g1> { ?b <urn:p> ?c } }") == across


def test_facts_split_over_graphs_are_whole_in_the_merge(spark):
    fact = [("urn:f", TYPE, V("Relation")), ("urn:f", V("relationType"), V("knows")), ("urn:f", V("sourceEntity"), "urn:a"), ("urn:f", V("targetEntity"), "urn:b")]
    split = dataset(spark, {"urn:one": fact[:2], "urn:two": fact[1:]})
    whole = "?f a v:Relation ; v:relationType ?r ; v:sourceEntity ?a ; v:targetEntity ?b"
    assert rows(split, f"SELECT ?r ?a ?b WHERE {{ {whole} }}") == [(V("knows"), "urn:a", "urn:b")]
    assert rows(split, f"SELECT ?a WHERE {{ GRAPH ?g {{ {whole} }} }}") == []
    assert rows(split, "SELECT ?g ?f WHERE { GRAPH ?g { ?f a v:Relation } }") == [("urn:one", "urn:f")]
    assert rows(split, "SELECT ?g ?a ?b WHERE { GRAPH ?g { ?f v:relationType ?r ; v:sourceEntity ?a ; v:targetEntity ?b } }") == [("urn:two", "urn:a", "urn:b")]
    counts = rows(split, "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")
    assert counts == [("urn:one", "2"), ("urn:two", "3")]


def test_stored_and_pruned(spark, data, random_graphs, tmp_path):
    data.write(str(tmp_path / "d"))
    stored = Dataset.read(spark, str(tmp_path / "d"), V)
    text = "SELECT ?g ?a ?c WHERE { GRAPH ?g { ?a <urn:p> ?b . ?b <urn:q> ?c } }"
    assert rows(stored, text) == rows(data, text)
    assert rows(stored, "SELECT ?a FROM <urn:g1> WHERE { ?a <urn:p> ?b }") == rows(data, "SELECT ?a FROM <urn:g1> WHERE { ?a <urn:p> ?b }")
    one = select(stored, "SELECT ?a ?b WHERE { GRAPH <urn:g1> { ?a <urn:p> ?b } }")
    assert len(one.inputFiles()) > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "urn:g1" in plan.split("PartitionFilters")[1]
    assert "Exchange" not in plan


def test_quads_of_lines(spark, tmp_path):
    (tmp_path / "a.nq").write_text('# none\n<urn:a> <urn:p> <urn:b> <urn:g> .\n\n<urn:a> <urn:p> "x. <y>"@EN _:g .\n_:n <urn:p> _:m.\n<urn:a> <urn:p> "1"^^<urn:t> <urn:g>.\n')
    got = {(r.o, r.o_lang, r.o_datatype, r.graph and r.graph[:2]) for r in read_nquads(spark, [str(tmp_path)]).collect() if r.s_kind == "iri"}
    assert got == {("urn:b", None, None, "ur"), ("x. <y>", "en", None, "_:"), ("1", None, "urn:t", "ur")}
    blank = read_nquads(spark, [str(tmp_path)]).where("s_kind = 'bnode'").first()
    assert blank.graph is None and blank.o_kind == "bnode"
    loose = Dataset.from_quads(read_nquads(spark, [str(tmp_path)]), V)
    assert len(rows(loose, "SELECT ?s ?o WHERE { ?s <urn:p> ?o }")) == 4 and len(rows(loose, "SELECT ?s ?o WHERE { GRAPH ?g { ?s <urn:p> ?o } }")) == 3


def test_what_is_refused(spark, data):
    plain = KnowledgeGraph.from_triples(spark.createDataFrame([], TRIPLES), V)
    for source, text in ((plain, "SELECT ?s WHERE { GRAPH ?g { ?s ?p ?o } }"), (plain, "SELECT ?s FROM <urn:a> WHERE { ?s ?p ?o }"), (data, "SELECT ?s WHERE { GRAPH ?g { SELECT ?s { ?s ?p ?o } } }"), (data, 'SELECT ?s WHERE { GRAPH "g" { ?s ?p ?o } }')):
        with pytest.raises(SparqlError):
            select(source, text)
    empty = Dataset.from_quads(named({"urn:g": spark.createDataFrame([], TRIPLES)}), V)
    assert rows(empty, "SELECT ?g ?s WHERE { GRAPH ?g { ?s ?p ?o } }") == [] and rows(empty, "SELECT ?l WHERE { ?s <%s> ?l }" % LABEL) == []


def test_patterns_in_any_graph_are_linked_from_outside(data, random_graphs):
    text = "SELECT ?a ?c ?d ?g WHERE { GRAPH <urn:g0> { ?a <urn:p> ?b } GRAPH ?g { ?a <urn:q> ?c . ?b <urn:q> ?d } }"
    query = parse(text)
    inside = [e for e in query.where if e[0] == "graph"][1]
    assert len(Compiler(data.default, data).in_graph(inside[1], inside[2])) == 2  # no product of the graph with itself
    edges = [(s, o) for s, x, o in random_graphs["urn:g0"] if x == "urn:p"]
    want = [(a, c, d, g) for g, own in random_graphs.items() for a, b in edges for s, x, c in own if (s, x) == (a, "urn:q") for t, y, d in own if (t, y) == (b, "urn:q")]
    assert rows(data, text) == sorted(want) != []

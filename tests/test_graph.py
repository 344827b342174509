from pathlib import Path

import pytest

from lattica.operators import lookups
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.labels import LabelIndex
from lattica.plans.service import answer_question
from lattica.plans.sparql import select
from lattica.plans.sparql.syntax import SparqlError
from lattica.sources.catalog import Catalog
from lattica.sources.starkg import star_graph
from lattica.sources.turtle import TurtleError, parse_turtle, read_ntriples, read_turtle

DATA = Path(__file__).parent / "data"
FILES = [f"file://{DATA}/{n}.ttl" for n in ("schema", "core", "missing", "aligned")]
HEADER = "PREFIX kg: <urn:lattica:kg#> PREFIX : <urn:t:> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"


@pytest.fixture(scope="module")
def triples(spark):
    return read_turtle(spark, FILES).cache()


@pytest.fixture(scope="module")
def kg(triples):
    return KnowledgeGraph.from_triples(triples).persist()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_union_is_a_set_and_blanks_stay_apart(triples):
    assert triples.count() == triples.distinct().count()
    labels = triples.where("s_kind = 'bnode' AND o IN ('一', '二')").collect()
    assert len({r.s for r in labels}) == 2
    assert triples.where("o = 'a\n\"b一'").count() == 1
    assert {(r.o, r.o_datatype.split("#")[1]) for r in triples.where("o_datatype is not null").collect()} == {("75", "integer"), ("1", "integer"), ("2.5", "decimal"), ("true", "boolean")}


def test_missing_files(spark):
    with pytest.raises(FileNotFoundError):
        read_turtle(spark, [FILES[2]])
    with pytest.raises(TurtleError):
        parse_turtle("<urn:a> <urn:b> ")
    with pytest.raises(TurtleError):
        parse_turtle("x:a <urn:b> <urn:c> .")


def test_lookups(kg):
    assert rows(lookups.courtesy_name(kg, "文彭")) == [("urn:t:wp", "文彭", "urn:t:shoucheng", "", "urn:t:shoucheng")]
    assert rows(lookups.birth_death(kg, "文彭")) == [("urn:t:short", "文", "", ""), ("urn:t:wp", "文彭", "1497 / 1498", "1573")]
    assert [r[4] for r in rows(lookups.art_name(kg, "文彭"))] == ["三桥", "渔阳"]
    assert [(r[1], r[3]) for r in rows(lookups.social_relations(kg, "丙"))] == [("丙", "文彭")]
    assert [r[3] for r in rows(lookups.social_relations(kg, "文彭"))] == ["丙", "文徵明"]
    assert [(r[3], r[4]) for r in rows(lookups.family_relations(kg, "文彭"))] == [("文徵明", "父亲")]
    assert rows(lookups.school_founder(kg, "吴门")) == [("urn:t:nolabel", "urn:t:nolabel", "urn:t:school", "吴门印派")]
    assert rows(lookups.template_founder(kg, "吴门")) == [("urn:t:nolabel", "", "urn:t:school", "吴门印派")]
    assert [r[4] for r in rows(lookups.pair_relations(kg, "文徵明", "文彭"))] == ["正向", "反向", "正向"]
    assert [r[0] for r in rows(lookups.person_labels(kg, "文"))] == ["urn:t:short", "urn:t:wp", "urn:t:wzm"]
    assert "urn:t:nolabel" not in {r[2] for r in rows(lookups.related_people(kg, "文彭"))}
    assert answer_question(kg, "文彭的生卒年是什么？").answer == "“文彭”的生卒年信息包括：1497 / 1498 - 1573"
    assert answer_question(kg, "文彭的师承是？").answer == "图谱中暂时没有查到与“文彭”相关的结果。"


def test_store_round_trip(kg, spark, tmp_path):
    kg.write(str(tmp_path / "kg"))
    again = KnowledgeGraph.read(spark, str(tmp_path / "kg"))
    for name in ("facts", "labels", "types", "others"):
        a, b = getattr(kg, name), getattr(again, name)
        assert sorted(map(str, rows(a.select(sorted(a.columns))))) == sorted(map(str, rows(b.select(sorted(b.columns)))))
    plan = again.facts_of("hasFriend")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel_type" in plan
    assert kg.triples().exceptAll(again.triples()).isEmpty()


def test_ntriples(spark, tmp_path):
    path = tmp_path / "a.nt"
    path.write_text('# c\n<urn:a> <urn:p> "x\\n\\"y\\\\t\\u4e00"@EN .\n_:b <urn:p> <urn:c> .\n<urn:a> <urn:p> "1"^^<urn:int> . # end\n\n<urn:a> <urn:p> _:b .\n', encoding="utf-8")
    got = {(r.s_kind, r.o_kind): r for r in read_ntriples(spark, [str(path)]).where("o_datatype is null").collect()}
    assert got[("iri", "literal")].o == 'x\n"y\\t一' and got[("iri", "literal")].o_lang == "en"
    assert got[("iri", "bnode")].o == got[("bnode", "iri")].s
    path.write_text("nonsense\n")
    with pytest.raises(Exception, match="no statement"):
        read_ntriples(spark, [str(path)]).collect()


def test_audit(spark, tmp_path):
    (tmp_path / "data" / "kg").mkdir(parents=True)
    (tmp_path / "data" / "kg" / "core.ttl").write_text("")
    audit = Catalog(str(tmp_path)).audit(spark).collect()
    assert len(audit) == 17 and [r.item for r in audit if r.exists] == ["core_ttl"]


SPARQL = [
    ("SELECT ?l { ?p a kg:Person ; rdfs:label ?l } ORDER BY DESC(?l) LIMIT 2", [("文徵明",), ("文彭",)]),
    ("SELECT ?l { ?p a kg:Person ; rdfs:label ?l } ORDER BY ?l LIMIT 2 OFFSET 1", [("文",), ("文彭",)]),
    ("SELECT ?t (COUNT(?f) AS ?n) { ?f kg:relationType ?t } GROUP BY ?t ORDER BY DESC(?n) ?t LIMIT 2", [("urn:lattica:kg#hasFriend", "3"), ("urn:lattica:kg#bornIn", "1")]),
    ("SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?t) AS ?m) { ?f kg:relationType ?t }", [("9", "7")]),
    ("SELECT ?t (COUNT(?f) AS ?n) { ?f kg:relationType ?t } GROUP BY ?t HAVING (COUNT(?f) > 1)", [("urn:lattica:kg#hasFriend", "3")]),
    ("SELECT ?p { ?p a kg:Person FILTER NOT EXISTS { ?p rdfs:label ?l } }", [("urn:t:nolabel",)]),
    ("SELECT ?p { ?p a kg:Person FILTER EXISTS { ?p kg:age ?x } }", [("urn:t:wp",)]),
    ("SELECT ?p { ?p a kg:Person MINUS { ?p rdfs:label ?l } }", [("urn:t:nolabel",)]),
    ("SELECT ?p ?x { VALUES (?p ?x) { (:wp 1) (:c UNDEF) } ?p a kg:Person } ORDER BY ?p", [("urn:t:c", ""), ("urn:t:wp", "1")]),
    ("SELECT ?p { ?p rdfs:label ?l FILTER(?l IN (\"丙\", \"文\")) } ORDER BY ?p", [("urn:t:c",), ("urn:t:short",)]),
    ("SELECT ?p { ?p rdfs:label ?l FILTER(LANG(?l) = 'zh' && LANGMATCHES(LANG(?l), 'ZH')) }", [("urn:t:wp",)]),
    ("SELECT ?p { ?p rdfs:label \"文彭\" }", []),
    ("SELECT ?p { ?p rdfs:label \"文彭\"@zh }", [("urn:t:wp",)]),
    ("SELECT ?x { ?p kg:age ?a FILTER(?a > 70 && ?a = 75.0) BIND(?a + 1 AS ?x) }", [("76",)]),
    ("SELECT ?s { :wp kg:note ?n BIND(CONCAT(UCASE(SUBSTR(?n, 1, 1)), '-', STRBEFORE('a-b', '-'), STRAFTER('a-b', '-')) AS ?s) }", [("A-ab",)]),
    ("SELECT ?x ?y { BIND(REPLACE('banana', 'a', 'o') AS ?x) BIND(IF(REGEX('Abc', '^a', 'i'), 'yes', 'no') AS ?y) }", [("bonono", "yes")]),
    ("SELECT ?d ?e { :wp kg:age ?a ; kg:bornIn ?b BIND(DATATYPE(?a) AS ?d) BIND(DATATYPE(?b) AS ?e) }", [("http://www.w3.org/2001/XMLSchema#integer", "http://www.w3.org/2001/XMLSchema#string")]),
    ("SELECT ?o { :wp kg:diedIn ?o FILTER(isIRI(?o)) }", [("urn:t:place",)]),
    ("SELECT ?v { :wp kg:inner/kg:x ?v }", [("y",)]),
    ("SELECT ?v { :wp kg:list/<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>*/<http://www.w3.org/1999/02/22-rdf-syntax-ns#first> ?v } ORDER BY ?v", [("true",), ("1",), ("2.5",)]),
    ("SELECT ?p { \"75\"^^xsd:integer ^kg:age ?p }", [("urn:t:wp",)]),
    ("SELECT ?b { :wp (kg:bornIn|kg:age) ?b } ORDER BY ?b", [("1498",), ("75",)]),
    ("SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?v) (MIN(?a) AS ?m) (SAMPLE(?a) AS ?x) { :wp kg:age ?a }", [("75", "75", "75", "75")]),
    ("SELECT DISTINCT ?k { ?p ?k ?o FILTER(STRSTARTS(STR(?k), 'urn:lattica:kg#a')) }", [("urn:lattica:kg#age",)]),
    ("SELECT ?p ?y { ?p a kg:Person OPTIONAL { ?p kg:age ?y FILTER(?y > 100) } } ORDER BY ?p LIMIT 1", [("urn:t:c", "")]),
    ("SELECT ?x { { BIND(1 AS ?x) } UNION { BIND('b' AS ?x) } } ORDER BY ?x", [("b",), ("1",)]),
    ("SELECT ?p { ?p a kg:Person . ?p !(rdfs:label|kg:fatherOfNote|kg:age|kg:note|kg:list|kg:inner|kg:bornIn|kg:diedIn) kg:Person } ORDER BY ?p LIMIT 1", [("urn:t:c",)]),
]


@pytest.mark.parametrize("text, want", SPARQL, ids=range(len(SPARQL)))
def test_sparql(kg, text, want):
    assert rows(select(kg, HEADER + text)) == want


def test_path_cycles_end(kg, spark):
    from lattica.plans.model import TRIPLES

    edges = [(f"urn:n{a}", "iri", "urn:e", f"urn:n{b}", "iri", None, None) for a, b in ((1, 2), (2, 3), (3, 1), (4, 1))]
    ring = KnowledgeGraph.from_triples(spark.createDataFrame(edges, TRIPLES))
    assert [r[0] for r in rows(select(ring, "SELECT ?x { <urn:n1> <urn:e>+ ?x } ORDER BY ?x"))] == ["urn:n1", "urn:n2", "urn:n3"]
    assert [r[0] for r in rows(select(ring, "SELECT ?x { ?x <urn:e>+ <urn:n2> } ORDER BY ?x"))] == ["urn:n1", "urn:n2", "urn:n3", "urn:n4"]
    assert len(rows(select(ring, "SELECT ?x ?y { ?x <urn:e>* ?y }"))) == 13
    assert len(rows(select(ring, "SELECT ?x ?y { ?x <urn:e>? ?y }"))) == 8


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?p { ?p a kg:Person ; rdfs:label ?l FILTER EXISTS { { ?q a kg:Person FILTER(?l = 'x') } } }",
        "SELECT ?p { ?p a kg:Person ; rdfs:label ?l FILTER EXISTS { ?q a kg:Person BIND(STRLEN(?l) AS ?n) } }",
        "SELECT ?p { ?p a kg:Person ; rdfs:label ?l FILTER EXISTS { ?q a kg:Person FILTER(?l != 'x' && EXISTS { ?q rdfs:label ?m FILTER(?m = ?l) }) } }",
    ],
)
def test_outer_variables_that_cannot_be_lifted(kg, text):
    with pytest.raises(SparqlError):
        rows(select(kg, HEADER + text))


def test_exists_with_outer_variables(kg):
    longer = "SELECT ?l { ?p a kg:Person ; rdfs:label ?l FILTER NOT EXISTS { ?q a kg:Person ; rdfs:label ?m FILTER(STRLEN(?m) > STRLEN(?l)) } }"
    labels = [r[0] for r in rows(select(kg, HEADER + "SELECT ?l { ?p a kg:Person ; rdfs:label ?l }"))]
    assert sorted(r[0] for r in rows(select(kg, HEADER + longer))) == sorted(x for x in labels if len(x) == max(map(len, labels)))
    assert rows(select(kg, HEADER + "SELECT ?p { ?p a kg:Person FILTER EXISTS { ?q a kg:Person FILTER(?unbound = ?q) } }")) == []


def test_single_facts_unfold_without_distinct(spark):
    from dataclasses import replace

    from lattica.sources.starkg import star_graph

    kg = star_graph(spark, "/root/testdata/sf0.001")
    kept = replace(kg, facts=kg.facts_of("hasCourtesyName"))
    aggregates = lambda g: g.triples().where("s_kind is not null")._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert kg.single and aggregates(kept) == aggregates(replace(kept, single=False)) - 4
    assert sorted(map(tuple, kept.triples().collect()), key=str) == sorted(map(tuple, replace(kept, single=False).triples().collect()), key=str)


def test_a_table_of_texts_meets_only_labels_that_hold_them(spark):
    names = [f"Name{i:03d}" for i in range(200)] + ["", "N", "文彭", "文彭𠀀"]
    labels = spark.createDataFrame([(f"n{i}", name, None) for i, name in enumerate(names)], "node string, label string, lang string")
    index = LabelIndex.of(labels, labels.select("node").limit(0))
    texts = ["Name007", "me1", "07", "文", "彭𠀀", "xName011y", "N", "文彭是谁", "none of them, and longer than all"]
    met = index.asked(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = sorted((r.text, r.label, r.forward) for r in met.collect())
    want = [(t, n, True) for t in texts for n in names if t in n] + [(t, n, False) for t in texts for n in names if n in t and n != t]
    assert got == sorted(want)
    assert "gram" not in met._jdf.queryExecution().optimizedPlan().toString()


def test_a_side_of_a_pair_is_written_first(spark):
    kg = star_graph(spark, "/root/testdata/sf0.001")
    plan = lookups.template_pair(kg, "Customer#000000005", "Customer#000000010")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_large_buckets_are_dealt_to_several_files(spark, tmp_path):
    labels = spark.range(20_000).selectExpr("'n' || id AS node", "'Same' || id AS label", "cast(null AS string) AS lang")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        LabelIndex.of(labels.repartition(8), labels.select("node")).write(str(tmp_path / "index"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    bucket = [p for p in (tmp_path / "index" / "exact").iterdir() if p.is_dir()]
    assert len(bucket) == 1 and len(list(bucket[0].glob("*.parquet"))) > 1

import pytest

from lattica.plans.service import TEMPLATES, TOOLS
from lattica.plans.sparql import SparqlError, parse, select
from lattica.plans.sparql.texts import Texts
from lattica.queries import PAIR, SCHOOL, TEN
from lattica.sources.starkg import star_graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kg(spark):
    return star_graph(spark, SF).persist()


@pytest.mark.parametrize("name", sorted(TOOLS | TEMPLATES))
def test_texts_say_what_the_lookups_say(kg, name):
    slots = PAIR if "pair" in name else (SCHOOL,) if "founder" in name else (TEN,)
    want = (TOOLS | TEMPLATES)[name](kg, *slots)
    got = select(kg, getattr(Texts(), name)(*slots))
    assert got.columns == want.columns
    rows = [tuple(r) for r in want.collect()]
    assert [tuple(r) for r in got.collect()] == rows and rows


@pytest.mark.parametrize("text", ["ASK { ?s ?p ?o }", "SELECT ?x", "SELECT ?x { ?x a:b ?c }", "SELECT ?x { ?x <urn:a> }", "SELECT * { SERVICE <urn:x> { ?s ?p ?o } }", "SELECT ?x WHERE { ?x <urn:p> 'a } "])
def test_errors(text):
    with pytest.raises(SparqlError):
        parse(text)


def test_arms_of_a_union_meet_a_capped_side_first(kg):
    plan = select(kg, Texts().related_people(TEN))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2

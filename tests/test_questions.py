"""Questions as a table, and lookups through the index of labels."""

from pathlib import Path

import pytest

from lattica.operators import lookups
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.service import FALLBACK, GENERATED_ERROR, TEMPLATES, TOOL_ERROR, TOOLS, answer_question, answer_questions
from lattica.sources.turtle import read_turtle

DATA = Path(__file__).parent / "data"
FILES = [f"file://{DATA}/{n}.ttl" for n in ("schema", "core", "aligned")]
QUESTIONS = [
    "文彭的字是什么？", "文彭的号是什么？", "文彭的生卒年是什么？", "文彭的师承是？", "文彭的父亲是谁", "丙的交游", "文彭属于什么流派", "谁开创了吴门", "文徵明与文彭是什么关系？",
    "文", "无此人的字是什么", "文徵明与文彭是什么关系呢请说明", "？", "", None, "请比较不同时期人物活动地点的变化", "谁开创了吴门印派这一流派的人", "文彭的字是什么？",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kg") / "graph")
    kg = KnowledgeGraph.from_triples(read_turtle(spark, FILES)).persist()
    kg.write(path)
    return kg, KnowledgeGraph.read(spark, path)


@pytest.mark.parametrize("name", ["文彭", "文", "吴门", "丙", "不在", "文徵明先生", "彭"])
def test_the_index_finds_what_a_scan_finds(stored, name):
    kg, indexed = stored
    for persons in (True, False):
        for both in (True, False):
            want = sorted(map(tuple, lookups.matching(kg, name, both, persons).collect()))
            assert sorted(map(tuple, lookups.matching(indexed, name, both, persons).collect())) == want
    assert lookups.related_people(indexed, name).collect() == lookups.related_people(kg, name).collect()


def test_the_empty_text(stored, spark):
    kg, indexed = stored
    assert lookups.matching(indexed, "").count() == lookups.matching(kg, "").count() > 3
    slots = spark.createDataFrame([(["",],), (["文彭"],)], "_q array<string>")
    got = {tuple(r._q): r.n for r in lookups.matching(indexed, lookups.asked(indexed, slots)[0]).groupBy("_q").agg({"node": "count"}).withColumnRenamed("count(node)", "n").collect()}
    assert got == {("",): lookups.matching(kg, "").count(), ("文彭",): lookups.matching(kg, "文彭").count()}


def test_a_lookup_reads_few_partitions(stored):
    _, indexed = stored
    plan = lookups.matching(indexed, "文彭", both_ways=False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram" in plan and "labels" not in plan


def test_a_table_of_questions_is_answered_as_one_by_one(stored, spark):
    kg, indexed = stored
    table = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "id int, question string")
    got = {r.id: r for r in answer_questions(indexed, table).collect()}
    assert len(got) == len(QUESTIONS)
    for i, q in [*enumerate(QUESTIONS)][::2]:
        want = answer_question(kg, q or "")
        assert (got[i]["mode"], got[i]["answer"]) == (want.mode, want.answer), q
        assert got[i]["rows"] == want.rows and got[i]["notes"] == want.notes
    assert got[15]["answer"] == FALLBACK and got[17]["answer"] == got[0]["answer"] and got[14]["mode"] == "empty"


def test_every_lookup_takes_many_names(stored, spark):
    kg, indexed = stored
    names = ["文彭", "文徵明", "吴门印派", "丙", "不在"]
    for intent, run in (TOOLS | TEMPLATES).items():
        two = intent in ("pair_relations", "fs_pair")
        slots = [[a, b] for a in names[:2] for b in names[:3]] if two else [[n] for n in names]
        table = spark.createDataFrame([(s,) for s in slots], "_q array<string>")
        rows = run(indexed, *lookups.asked(indexed, table)[: 1 + two]).collect()
        for s in slots:
            assert sorted(tuple(r)[1:] for r in rows if r._q == s) == sorted(map(tuple, run(kg, *s).collect())), (intent, s)


def test_a_graph_that_cannot_be_loaded(spark):
    def broken():
        raise FileNotFoundError("no graph")

    table = spark.createDataFrame([("文彭的字是什么？",), ("文徵明与文彭是什么关系呢请说明",), ("",)], "question string")
    got = {r.question: (r["mode"], r["answer"], r["notes"]) for r in answer_questions(broken, table).collect()}
    assert got["文彭的字是什么？"] == ("tool_error", TOOL_ERROR, ["no graph"])
    assert got["文徵明与文彭是什么关系呢请说明"] == ("generated_sparql", GENERATED_ERROR, ["no graph"])
    assert got[""][0] == "empty"
    assert answer_questions(broken, table.where("false")).collect() == []

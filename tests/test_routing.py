import pytest

from lattica.plans.model import QueryResult
from lattica.plans.routing import route, route_questions
from lattica.plans.service import answer_question, health, run_sparql
from lattica.sources.starkg import star_graph

GOLDEN = [
    ("文彭是谁？", "tool", "person_labels", ["文彭"]),
    ("文彭的字是什么？", "tool", "courtesy_name", ["文彭"]),
    ("文彭的号是什么？", "tool", "art_name", ["文彭"]),
    ("文彭的生卒年是什么？", "tool", "birth_death", ["文彭"]),
    ("文徵明与文彭是什么关系？", "tool", "pair_relations", ["文徵明", "文彭"]),
    ("文彭的师承是？", "tool", "teacher_relations", ["文彭"]),
    ("谁开创了吴门印派？", "tool", "school_founder", ["吴门印派"]),
    ("某人的师承关系是什么？", "tool", "teacher_relations", ["关系是什么"]),
    ("某人属于什么流派？", "tool", "school_membership", ["某人"]),
    ("某人的交游圈有哪些人？", "tool", "social_relations", ["某人的"]),
    ("文彭字是什么", "tool", "courtesy_name", ["是什么"]),
    ("文彭的老师是谁", "tool", "person_labels", ["文彭的老师"]),
    ("文彭的生卒年", "tool", "person_labels", ["文彭的生卒年"]),
    ("介绍文彭", "tool", "person_labels", ["文彭"]),
    ("谁创立了某流派", "tool", "school_membership", ["谁创立了某"]),
    ("谁开创了", "tool", "school_founder", ["谁"]),
    ("文徵明与文彭是什么关系呢请说明", "generated_sparql", "fs_pair", ["文徵明", "文彭"]),
    ("？", "fallback", None, []),
    ("", "empty", None, []),
    (" 　\n", "empty", None, []),
    ("请比较不同时期人物活动地点的变化", "fallback", None, []),
    ("　文彭 ？", "tool", "person_labels", ["文彭 "]),
]


@pytest.mark.parametrize("question, kind, intent, slots", GOLDEN)
def test_scalar(question, kind, intent, slots):
    got = route(question)
    assert (got.route_type, got.intent, list(got.slots)) == (kind, intent, slots)


def test_column_form_agrees(spark):
    got = route_questions(spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, question string")).collect()
    assert [(r.question, r.route_type, r.intent, r.slots) for r in sorted(got, key=lambda r: r.i)] == GOLDEN


def test_answers_end_to_end(spark):
    kg = star_graph(spark, "/root/testdata/sf0.001")
    got = answer_question(kg, "Customer#000000005的字是什么？")
    assert got.mode == "tool" and len(got.rows) == 1 and got.answer == f"“Customer#000000005”的字信息包括：{got.rows[0]['courtesyName']}"
    assert answer_question(kg, "") == QueryResult("empty", "请输入问题。")
    assert answer_question(kg, "请比较不同时期人物活动地点的变化").mode == "fallback"
    assert answer_question(kg, "查无此人是谁").answer == "图谱中暂时没有查到与“查无此人”相关的结果。"
    pair = answer_question(kg, "Customer#000000005与Customer#000000010是什么关系")
    assert pair.answer == "“Customer#000000005、Customer#000000010”的人物关系信息包括：正向：fatherOf"
    generated = answer_question(kg, "Customer#000000005与Customer#000000010是什么关系呢请说明")
    assert generated.mode == "generated_sparql" and "relationLabel=fatherOf" in generated.answer

    def broken():
        raise FileNotFoundError("no graph")

    assert answer_question(broken, "文彭是谁").mode == "tool_error"
    assert {r.table for r in health(kg).collect()} == {"facts", "labels", "types", "others"}
    with pytest.raises(ValueError):
        run_sparql(kg, "  ")


def test_questions_of_one_file_are_routed_by_many_tasks(spark):
    from lattica.queries import QUERIES

    assert QUERIES["route_questions"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

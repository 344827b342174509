import json
import math

from lattica.operators import alignment, network
from lattica.plans import answers
from lattica.sources.starkg import star_graph
from lattica.streaming.extraction import extract_stream


def graph(spark, rows, columns):
    return network.property_graph(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split())), "t")


def test_first_rule_wins_and_types_stay(spark):
    g = graph(spark, [("a", "b", "s"), ("a", "", "s"), ("c", None, ""), ("a", "b", "s")], "label teacherLabel schoolLabel")
    nodes = {r.id: (r.type, r["size"]) for r in g.nodes.collect()}
    # Without a teacher the school rule fits; the row without both adds its label by the generic rule.
    assert nodes == {"a": ("person", 22), "b": ("person", 22), "s": ("school", 18), "c": ("unknown", 18)}
    assert {(r.source, r.target, r.label) for r in g.edges.collect()} == {("a", "b", "师承"), ("a", "s", "所属流派")}
    meta = g.meta.first()
    assert (meta.rowCount, meta.nodeCount, meta.edgeCount, meta.warnings) == (4, 4, 2, [])


def test_generic_rules_and_warnings(spark):
    g = graph(spark, [("x", "y", "")], "courtesyLabel label relation")
    assert [(r.source, r.target, r.label) for r in g.edges.collect()] == [("x", "y", "关联")]
    one = graph(spark, [(" p ",)], "placeLabel")
    assert [(r.id, r.type) for r in one.nodes.collect()] == [("p", "place")]
    assert one.meta.first().warnings == [network.WARN_NO_EDGE, network.WARN_FEW]
    loops = graph(spark, [("a", "a", "r"), ("b", "b", "r")], "sourceLabel targetLabel relation")
    assert loops.edges.count() == 0 and loops.meta.first().warnings == [network.WARN_NO_EDGE, network.WARN_LOOSE]
    assert graph(spark, [], "label").meta.first().warnings == []
    assert graph(spark, [("v",)], "value").nodes.count() == 0
    named = graph(spark, [("a", "b", "", "亲")], "sourceLabel targetLabel relationLabel relationType")
    assert named.edges.first().label == "亲"


def test_layout(spark):
    g = graph(spark, [("a", "b", "r"), ("c", "d", "r")], "sourceLabel targetLabel relation")
    at = {r.id: (r.x, r.y) for r in network.circular_layout(g.nodes).collect()}
    for k, n in enumerate("abcd"):
        angle = 2 * math.pi * k / 4 - math.pi / 2
        assert math.dist(at[n], (380 + 138 * math.cos(angle), 210 + 138 * math.sin(angle))) < 1e-9
    single = network.circular_layout(graph(spark, [("p",)], "placeLabel").nodes).first()
    assert (single.x, single.y) == (380, 210)


def test_answer_texts(spark):
    df = spark.createDataFrame([(f"p{i:02}", "x" if i < 2 else f"v{i:02}") for i in range(14)], "label string, courtesyName string")
    assert answers.answer(df, "courtesy_name", ["某"]).first()[0] == "“某”的字信息包括：x、" + "、".join(f"v{i:02}" for i in range(2, 11))
    blank = spark.createDataFrame([("a", "")], "label string, courtesyName string")
    assert answers.answer(blank, "courtesy_name", ["{x}", "y"]).first()[0] == "图谱里查到了“{x}、y”的候选实体，但还没有可展示的字信息。"
    assert answers.answer(blank.limit(0), "courtesy_name", ["某"]).first()[0] == "图谱中暂时没有查到与“某”相关的结果。"
    assert answers.answer(blank, "person_labels", ["某"]).first()[0] == "图谱里与“某”相关的候选标签有：a"
    years = spark.createDataFrame([("a", "1498", ""), ("b", "", "1573"), ("c", "", ""), ("d", "1", "2"), ("d", "1", "2")], "label string, birthYear string, deathYear string")
    assert answers.answer(years, "birth_death", ["某"]).first()[0] == "“某”的生卒年信息包括：1498、1573、1 - 2、1 - 2"
    assert answers.summary(spark.createDataFrame([("a", ""), ("b", "c")], "x string, y string")).first()[0].endswith("：x=a；x=b，y=c")
    assert answers.summary(blank.limit(0)).first()[0] == answers.GENERATED_EMPTY


def test_alignment_candidates(spark):
    people = spark.createDataFrame([("n1", "a", "c", "p1", "1500", "1570"), ("n2", "b", "c", "p1", None, None), ("n3", "z", "q", "p1", None, None), ("n4", "d", "c", "p2", "1500", "1570")], "node string, name string, courtesy string, place string, birth string, death string")
    external = spark.createDataFrame(
        [("e1", "a", "c", "p1", "1498", "1573"), ("e2", "a", "c", "p2", None, None), ("e3", "b", "c", "p1", None, None), ("e4", "b", "c", "p1", None, None), ("e5", "d", "c", "p2", "1700", "1750"), ("e6", "a", "c", "p3", None, None)],
        "ext_id string, name string, courtesy string, place string, birth string, death string",
    )
    regions = spark.createDataFrame([("p1", "r"), ("p2", "r"), ("p3", "s")], "place string, region string")
    got = {r.node: r for r in alignment.resolve(alignment.match(people, external, regions)).collect()}
    assert (got["n1"].status, got["n1"].tier, got["n1"].ext_id, got["n1"].candidates) == ("aligned", 1, "e1", ["e1", "e2", "e6"])
    assert (got["n2"].status, got["n2"].candidates) == ("partial", ["e3", "e4"])
    assert (got["n3"].status, got["n3"].candidates) == ("insufficient_data", [])
    assert (got["n4"].status, got["n4"].ext_id) == ("insufficient_data", None)
    kg = star_graph(spark, "/root/testdata/sf0.001")
    said = alignment.supplements(kg, alignment.resolve(alignment.match(people, external, regions)), external).collect()
    n1 = {(r.p.split("#")[-1], r.o) for r in said if r.s == "n1"}
    assert n1 == {("sameAs", "e1"), ("alignmentStatus", "aligned"), ("alignmentMethod", "tier-1"), ("cbdbId", "e1"), ("bornIn", "1498"), ("diedIn", "1573")}
    fuzzy = alignment.match(people.replace("a", "aa", "name"), external, regions, "fuzzy")
    assert fuzzy.where("node = 'n1' and ext_id = 'e1'").count() == 1


class Echo:
    def invoke(self, prompt):
        return '{"entities": [{"name": "x", "category": "y"}]}'


def test_stream_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(name, rid):
        (source / name).write_text(json.dumps({"record_id": rid, "person_name": "p", "source_text": "t", "text_length": 1}) + "\n")

    for name, rid in (("a.json", "1"), ("b.json", "2")):
        put(name, rid)
        extract_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), Echo).awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.record_id for r in got.collect()) == ["1", "2"] and got.first().entities[0].name == "x"

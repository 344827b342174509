"""The fixed questions to a knowledge graph, as plans.

Each takes the text of a name and returns a capped result of string columns,
unbound values as ''. A cap keeps the first rows in the order of all columns,
so results are the same in every run. Names bind as literals: no query text is
built. Candidate sides are capped first and broadcast (30 rows at most). A graph
that is stored with an index of labels is asked through it.

Every lookup also takes many names at once (``Asked``): its rows then carry the
names they answer in ``_q``, caps hold for each, and candidates are joined
instead of broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.lineage import folder
from lattica.plans.graph import KnowledgeGraph

#: Caps of candidates and results, and the tags of a relation's
#: reading direction.
CANDIDATES = 30
PAIR_CANDIDATES = 20
CHILD, PARENT = "子女", "父亲"
FORWARD, BACKWARD = "正向", "反向"
OUTGOING, INCOMING = "outgoing", "incoming"


@dataclass(frozen=True)
class Asked:
    """The names of one slot of many questions: ``slots`` has the distinct slots
    (_q, an array), ``at`` is the place of this one in them, and ``matches`` has
    the labels of the texts (``LabelIndex.asked``)."""

    slots: DataFrame
    at: int
    matches: DataFrame


def asked(kg: KnowledgeGraph, slots: DataFrame, matches: DataFrame | None = None) -> list[Asked]:
    """The arguments of a lookup of one slot, or of two, for many questions."""
    if matches is None:
        matches = kg.indexed().asked(slots.select(F.explode("_q").alias("text")).distinct())
    return [Asked(slots, at, matches) for at in (0, 1)]


def capped(rows: DataFrame, limit: int) -> DataFrame:
    if "_q" not in rows.columns:
        return rows.orderBy(*rows.columns).limit(limit)
    order = Window.partitionBy("_q").orderBy(*[c for c in rows.columns if c != "_q"])
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def _keyed(rows: DataFrame) -> list[str]:
    return ["_q"] if "_q" in rows.columns else []


def final(rows: DataFrame, columns: list[str], limit: int, distinct: bool = True) -> DataFrame:
    shown = rows.select(*_keyed(rows), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    return capped(shown.distinct() if distinct else shown, limit)


def says(label: Column, text: str, both_ways: bool = True) -> Column:
    """The label contains the text or, both ways, the text the label. (Equal
    labels contain each other.)"""
    found = label.contains(text)
    return found | F.lit(text).contains(label) if both_ways else found


def matching(kg: KnowledgeGraph, name: str | Asked, both_ways: bool = True, persons: bool = True) -> DataFrame:
    """(node, label) of the labels that a name may mean, a row a label."""
    if isinstance(name, Asked):
        texts = name.slots.select("_q", F.get("_q", F.lit(name.at)).alias("text"))
        found = name.matches.where((F.lit(both_ways) | F.col("forward")) & (F.lit(not persons) | F.col("person")))
        return texts.join(found, "text").select("_q", "node", "label")
    if kg.index is not None:
        return kg.index.matching(name, both_ways, persons).select("node", "label")
    return (kg.persons if persons else kg.labels).where(says(F.col("label"), name, both_ways)).select("node", "label")


def candidates(kg: KnowledgeGraph, name: str | Asked, cap: int = CANDIDATES, both_ways: bool = True, as_: tuple[str, str] = ("person", "label"), persons: bool = True) -> DataFrame:
    """The labelled persons, or nodes, whom a name may mean."""
    hit = matching(kg, name, both_ways, persons)
    rows = capped(hit.select(*_keyed(hit), F.col("node").alias(as_[0]), F.col("label").alias(as_[1])).distinct(), cap)
    return rows if isinstance(name, Asked) else F.broadcast(rows)


def labelled(kg: KnowledgeGraph, rows: DataFrame, node: str, label: str) -> DataFrame:
    """Adds the labels of a node column; a row for each label, null without."""
    names = kg.labels.select(F.col("node").alias("_node"), F.col("label").alias(label))
    return rows.join(names, F.col(node) == F.col("_node"), "left").drop("_node")


def shown(kg: KnowledgeGraph, rows: DataFrame, node: str, label: str) -> DataFrame:
    """Adds the labels of a node column, or the node itself without any."""
    return labelled(kg, rows, node, label).withColumn(label, F.coalesce(label, node))


def person_labels(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    return final(matching(kg, name, both_ways=False).withColumnRenamed("node", "person"), ["person", "label"], 20)


def _related(kg: KnowledgeGraph, name: str | Asked, relation: str, value: str) -> DataFrame:
    edges = kg.facts_of(relation).select(F.col("source").alias("person"), F.col("target").alias(value))
    return edges.join(candidates(kg, name), "person")


def _named(kg: KnowledgeGraph, name: str | Asked, relation: str, kind: str) -> DataFrame:
    node, label, alias = f"{kind}Node", f"{kind}Label", f"{kind}Name"
    rows = labelled(kg, _related(kg, name, relation, node), node, label).withColumn(alias, F.coalesce(label, node))
    return final(rows, ["person", "label", node, label, alias], 30)


def courtesy_name(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    return _named(kg, name, "hasCourtesyName", "courtesy")


def art_name(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    return _named(kg, name, "hasArtName", "art")


def teacher_relations(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    rows = shown(kg, _related(kg, name, "hasTeacher", "teacher"), "teacher", "teacherLabel")
    return final(rows, ["person", "label", "teacher", "teacherLabel"], 30)


def school_membership(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    rows = shown(kg, _related(kg, name, "belongsToSchool", "school"), "school", "schoolLabel")
    return final(rows, ["person", "label", "school", "schoolLabel"], 30)


def _years(kg: KnowledgeGraph, people: DataFrame, relation: str, out: str) -> DataFrame:
    """(person, out): the distinct years of both encodings, in order."""
    keys = people.select("person").distinct()
    stated = kg.facts_of(relation).select(F.col("source").alias("person"), F.col("target").alias("_year")).join(keys, "person")
    stated = shown(kg, stated, "_year", "_item").select("person", "_item")
    direct = kg.literals_of(relation).select(F.col("node").alias("person"), F.col("value").alias("_item")).join(keys, "person")
    both = stated.unionByName(direct)
    return both.groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("_item")), " / ").alias(out))


def birth_death(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    people = candidates(kg, name)
    rows = people.join(_years(kg, people, "bornIn", "birthYear"), "person", "left").join(_years(kg, people, "diedIn", "deathYear"), "person", "left")
    return final(rows, ["person", "label", "birthYear", "deathYear"], 20, distinct=False)


def _both_ways(facts: DataFrame, one: str, other: str, forward: str, backward: str, tag: str) -> DataFrame:
    """Facts read from both ends, (one, other, tag, rel_type), in one scan."""
    way = lambda x, y, t: F.struct(F.col(x).alias(one), F.col(y).alias(other), F.lit(t).alias(tag))
    ends = F.explode(F.array(way("source", "target", forward), way("target", "source", backward)))
    return facts.select(ends.alias("_end"), "rel_type").select("_end.*", "rel_type")


def family_relations(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    edges = _both_ways(kg.facts_of("fatherOf"), "person", "relative", CHILD, PARENT, "relationType").join(candidates(kg, name), "person")
    return final(shown(kg, edges, "relative", "relativeLabel"), ["person", "label", "relative", "relativeLabel", "relationType"], 40)


def social_relations(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    edges = _both_ways(kg.facts_of("hasFriend"), "person", "friend", "", "", "tag").join(candidates(kg, name), "person")
    return final(shown(kg, edges, "friend", "friendLabel"), ["person", "label", "friend", "friendLabel"], 30)


def school_founder(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    schools = candidates(kg, name, as_=("school", "schoolLabel"), persons=False)
    edges = kg.facts_of("foundsSchool").select(F.col("source").alias("founder"), F.col("target").alias("school")).join(schools, "school")
    return final(shown(kg, edges, "founder", "founderLabel"), ["founder", "founderLabel", "school", "schoolLabel"], 20)


def pair_relations(kg: KnowledgeGraph, first: str | Asked, second: str | Asked) -> DataFrame:
    a = candidates(kg, first, PAIR_CANDIDATES, False, ("_a", "sourceLabel"))
    b = candidates(kg, second, PAIR_CANDIDATES, False, ("_b", "targetLabel"))
    # Facts meet each capped side in turn; the product of the sides never exists.
    edges = _both_ways(kg.facts, "_a", "_b", FORWARD, BACKWARD, "direction").withColumnRenamed("rel_type", "relation").join(a, "_a").join(b, ["_b", *_keyed(a)])
    return final(labelled(kg, edges, "relation", "relationLabel"), ["sourceLabel", "targetLabel", "relation", "relationLabel", "direction"], 30)


def related_people(kg: KnowledgeGraph, name: str | Asked) -> DataFrame:
    edges = _both_ways(kg.facts, "person", "related", OUTGOING, INCOMING, "direction").withColumnRenamed("rel_type", "relation").join(candidates(kg, name), "person")
    others = kg.persons.select(F.col("node").alias("related"), F.col("label").alias("relatedLabel"))
    rows = labelled(kg, edges.join(others, "related"), "relation", "relationLabel")
    return final(rows, ["person", "label", "related", "relatedLabel", "relation", "relationLabel", "direction"], 50)


# --- templates: bags, one-way matching, no caps on candidates ------------------


def _template_named(kg: KnowledgeGraph, name: str | Asked, relation: str, kind: str) -> DataFrame:
    people = matching(kg, name, both_ways=False).withColumnRenamed("node", "person")
    edges = kg.facts_of(relation).select(F.col("source").alias("person"), F.col("target").alias(f"{kind}Node")).join(people, "person")
    return final(labelled(kg, edges, f"{kind}Node", f"{kind}Label"), ["person", "label", f"{kind}Node", f"{kind}Label"], 20, distinct=False)


def template_courtesy_name(kg: KnowledgeGraph, person: str | Asked) -> DataFrame:
    return _template_named(kg, person, "hasCourtesyName", "courtesy")


def template_art_name(kg: KnowledgeGraph, person: str | Asked) -> DataFrame:
    return _template_named(kg, person, "hasArtName", "art")


def template_birth_death(kg: KnowledgeGraph, person: str | Asked) -> DataFrame:
    people = matching(kg, person, both_ways=False).withColumnRenamed("node", "person").distinct()
    rows = people.join(_years(kg, people, "bornIn", "birthYear"), "person", "left").join(_years(kg, people, "diedIn", "deathYear"), "person", "left")
    return final(rows, ["person", "label", "birthYear", "deathYear"], 20, distinct=False)


def template_pair(kg: KnowledgeGraph, person_a: str | Asked, person_b: str | Asked) -> DataFrame:
    def side(text: str | Asked, as_: tuple[str, str]) -> DataFrame:
        found = matching(kg, text, both_ways=False).withColumnsRenamed({"node": as_[0], "label": as_[1]})
        if isinstance(text, Asked):
            return found
        # Written first, so that its size is known: a small side is broadcast, and facts stay where they are.
        path = folder(kg.spark, "side")
        found.write.parquet(path)
        return kg.spark.read.schema(found.schema).parquet(path)

    a, b = side(person_a, ("_a", "sourceLabel")), side(person_b, ("_b", "targetLabel"))
    edges = _both_ways(kg.facts, "_a", "_b", FORWARD, BACKWARD, "direction").withColumnRenamed("rel_type", "relation").join(a, "_a").join(b, ["_b", *_keyed(a)])
    return final(labelled(kg, edges, "relation", "relationLabel"), ["sourceLabel", "targetLabel", "relation", "relationLabel", "direction"], 20, distinct=False)


def template_founder(kg: KnowledgeGraph, school: str | Asked) -> DataFrame:
    edges = kg.facts_of("foundsSchool").select(F.col("source").alias("founder"), F.col("target").alias("school"))
    schools = matching(kg, school, persons=False).withColumnsRenamed({"node": "school", "label": "schoolLabel"})
    rows = labelled(kg, edges, "founder", "founderLabel").join(schools, "school")
    return final(rows, ["founder", "founderLabel", "school", "schoolLabel"], 20, distinct=False)

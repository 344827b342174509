"""From a question to a plan: by rule to a lookup, else to a template, else to
the fallback. The rules are one table, read by the scalar form (a question) and
by the column form (a table of questions, as one projection)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as tx

#: The markers of each intent, in order; the first that leaves a
#: slot wins.
INTENTS: dict[str, tuple[str, ...]] = {
    "courtesy_name": ("的字是什么", "字是什么", "字"),
    "art_name": ("的号是什么", "号是什么", "号"),
    "birth_death": ("的生卒年是什么", "生卒年", "出生", "去世", "卒于"),
    "teacher_relations": ("的师承是", "师承", "老师是谁", "师从"),
    "family_relations": ("的父亲是谁", "的儿子是谁", "亲属", "家族", "父子", "兄弟"),
    "social_relations": ("交游", "朋友", "往来", "交往"),
    "school_membership": ("属于什么流派", "属于哪个流派", "所属流派", "流派"),
    "school_founder": ("谁开创了", "谁创立了", "开创了", "创立了"),
    "person_labels": ("是谁", "介绍", "查一下", "看看"),
}
#: The slot stands before these markers, after all others.
SLOT_BEFORE = (
    "是谁", "的字是什么", "的号是什么", "的生卒年是什么", "的师承是", "的父亲是谁", "的儿子是谁", "亲属", "家族", "父子", "兄弟", "交游",
    "朋友", "往来", "交往", "属于什么流派", "属于哪个流派", "所属流派", "流派", "开创了", "创立了",
)
PAIR = r"^(.+?)[与和](.+?)是什么关系"
SHORT = 8
TEMPLATE_FOUNDER = "谁开创了"
TEMPLATE_SUFFIXES = {"的字是什么": "fs_courtesy", "的号是什么": "fs_art", "的生卒年是什么": "fs_birth_death"}


@dataclass(frozen=True)
class Route:
    """``route_type`` is tool, generated_sparql, fallback or empty."""

    route_type: str
    intent: str | None = None
    slots: tuple[str, ...] = ()


def _tool(question: str) -> Route | None:
    q = question.strip().rstrip(tx.QUESTION_MARKS)
    if not q:
        return None
    if pair := re.match(PAIR + "$", q):
        slots = tuple(g.strip() for g in pair.groups())
        if all(slots):
            return Route("tool", "pair_relations", slots)
    for intent, markers in INTENTS.items():
        for marker in markers:
            head, found, tail = q.partition(marker)
            slot = (head if marker in SLOT_BEFORE else tail).strip().strip(tx.SLOT_MARKS) if found else ""
            if slot:
                return Route("tool", intent, (slot,))
    return Route("tool", "person_labels", (q,)) if len(q) <= SHORT else None


def _template(question: str) -> Route | None:
    q = question.strip().rstrip(tx.TEMPLATE_MARKS)
    if pair := re.match(PAIR, q):
        return Route("generated_sparql", "fs_pair", tuple(g.strip() for g in pair.groups()))
    if TEMPLATE_FOUNDER in q:
        return Route("generated_sparql", "fs_founder", (q.split(TEMPLATE_FOUNDER, 1)[1].strip(),))
    for suffix, name in TEMPLATE_SUFFIXES.items():
        if q.endswith(suffix):
            return Route("generated_sparql", name, (q.removesuffix(suffix).strip(),))
    return None


def route(question: str) -> Route:
    if not question.strip():
        return Route("empty")
    return _tool(question) or _template(question) or Route("fallback")


def _struct(kind: str, intent: Column | str | None, *slots: Column) -> Column:
    name = intent if isinstance(intent, Column) else F.lit(intent).cast("string")
    listed = F.array(*slots) if slots else F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("route_type"), name.alias("intent"), listed.alias("slots"))


def _rules() -> Column:
    """The rules as an array of structs, read from one literal."""
    listed = [{"intent": i, "marker": m, "ahead": m in SLOT_BEFORE} for i, markers in INTENTS.items() for m in markers]
    return F.from_json(F.lit(json.dumps(listed, ensure_ascii=False)), "array<struct<intent: string, marker: string, ahead: boolean>>")


def _first_rule(q: Column) -> Column:
    """struct(intent, slot) of the first rule whose marker leaves a slot."""
    def slot(r: Column) -> Column:
        at = F.instr(q, r["marker"])
        found = F.when(r["ahead"], F.substr(q, F.lit(1), at - 1)).otherwise(F.substr(q, at + F.length(r["marker"])))
        return F.struct(r["intent"].alias("intent"), tx.clean_slot(found).alias("slot"))

    there = F.filter(_rules(), lambda r: F.contains(q, r["marker"]))
    return F.get(F.filter(F.transform(there, slot), lambda r: r["slot"] != ""), F.lit(0))


def route_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """The questions with route_type, intent and slots. Each step is a
    projection of its own, so that nothing is written out twice."""
    pair, loose = "(?d)" + PAIR + r"\z", "(?d)" + PAIR
    q, t, rule = F.col("_r_q"), F.col("_r_t"), F.col("_r_rule")
    given = F.coalesce(F.col(column), F.lit(""))
    read = questions.select("*", tx.strip(given).alias("_r_given"))
    read = read.select("*", F.rtrim("_r_given", F.lit(tx.QUESTION_MARKS)).alias("_r_q"), F.rtrim("_r_given", F.lit(tx.TEMPLATE_MARKS)).alias("_r_t"))
    side = lambda text, pattern, i: tx.strip(F.regexp_extract(text, pattern, i))
    read = read.select("*", *[F.when(q.rlike(pair), side(q, pair, i)).otherwise("").alias(f"_r_{i}") for i in (1, 2)], _first_rule(q).alias("_r_rule"))
    both = [F.col("_r_1"), F.col("_r_2")]
    templates = [F.when(t.contains(TEMPLATE_FOUNDER), _struct("generated_sparql", "fs_founder", tx.strip(tx.after(t, TEMPLATE_FOUNDER))))]
    for suffix, name in TEMPLATE_SUFFIXES.items():
        templates.append(F.when(t.endswith(suffix), _struct("generated_sparql", name, tx.strip(F.substr(t, F.lit(1), F.length(t) - len(suffix))))))
    choice = F.coalesce(
        F.when(F.col("_r_given") == "", _struct("empty", None)),
        F.when((both[0] != "") & (both[1] != ""), _struct("tool", "pair_relations", both[0], both[1])),
        F.when(rule.isNotNull(), _struct("tool", rule["intent"], rule["slot"])),
        F.when((q != "") & (F.length(q) <= SHORT), _struct("tool", "person_labels", q)),
        F.when(t.rlike(loose), _struct("generated_sparql", "fs_pair", side(t, loose, 1), side(t, loose, 2))),
        *templates,
        _struct("fallback", None),
    )
    return read.withColumn("_r", choice).select(*questions.columns, "_r.route_type", "_r.intent", "_r.slots")

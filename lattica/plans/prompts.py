"""A prompt that shows a model the template queries and asks for another."""

from __future__ import annotations

from lattica.plans.model import Vocabulary
from lattica.plans.sparql.texts import Texts

#: A question for each template, with its slots.
EXAMPLES = (
    ("文彭的字是什么？", "fs_courtesy", ("文彭",)),
    ("文彭的号是什么？", "fs_art", ("文彭",)),
    ("文彭的生卒年是什么？", "fs_birth_death", ("文彭",)),
    ("文徵明与文彭是什么关系？", "fs_pair", ("文徵明", "文彭")),
    ("谁开创了吴门印派？", "fs_founder", ("吴门印派",)),
)


def sparql_prompt(question: str, vocabulary: Vocabulary = Vocabulary()) -> str:
    texts, p = Texts(vocabulary), vocabulary.prefix
    shown = "\n\n".join(f"问题：{q}\nSPARQL：\n{getattr(texts, name)(*slots)}" for q, name, slots in EXAMPLES)
    rules = f"请为知识图谱生成可执行的 SPARQL SELECT 查询。关系以 {p}:Relation 节点表示：{p}:relationType、{p}:sourceEntity、{p}:targetEntity。"
    return f"{rules}\n\n{shown}\n\n问题：{question}\nSPARQL："

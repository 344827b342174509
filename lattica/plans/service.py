"""Answering questions over a graph: plan, run, and say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.lineage import folder
from lattica.operators import lookups
from lattica.plans import answers
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import QueryResult, ToolResult, string_rows
from lattica.plans.routing import Route, route, route_questions

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "person_labels": lookups.person_labels,
    "courtesy_name": lookups.courtesy_name,
    "art_name": lookups.art_name,
    "birth_death": lookups.birth_death,
    "teacher_relations": lookups.teacher_relations,
    "family_relations": lookups.family_relations,
    "social_relations": lookups.social_relations,
    "school_membership": lookups.school_membership,
    "school_founder": lookups.school_founder,
    "pair_relations": lookups.pair_relations,
    "related_people": lookups.related_people,
}
TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    "fs_courtesy": lookups.template_courtesy_name,
    "fs_art": lookups.template_art_name,
    "fs_birth_death": lookups.template_birth_death,
    "fs_pair": lookups.template_pair,
    "fs_founder": lookups.template_founder,
}
#: Answers without rows.
EMPTY = "请输入问题。"
TOOL_ERROR = "工具查询已命中，但当前图谱数据或 SPARQL 执行还不可用。"
GENERATED_ERROR = "系统已经根据 few-shot 示例生成了候选 SPARQL，但当前还不能稳定执行。"
FALLBACK = "这条问题目前还没有命中固定工具规则，也没有匹配到可直接复用的 few-shot SPARQL 模板。"


def run_tool(kg: KnowledgeGraph, intent: str, slots: list[str] | tuple[str, ...]) -> ToolResult:
    """A lookup by name; an unknown intent lists labels."""
    found = (TOOLS | TEMPLATES).get(intent, lookups.person_labels)
    return ToolResult(intent, found(kg, *slots))


def _text(rows: DataFrame) -> str:
    return rows.first()["answer"]


def answer_question(kg: KnowledgeGraph | Callable[[], KnowledgeGraph], question: str, planner: Callable[[str], Route] = route) -> QueryResult:
    """Mode is empty, tool, tool_error, generated_sparql or fallback; an error
    of a lookup (a graph that cannot be loaded, say) becomes a result too."""
    plan = planner(question.strip())
    if plan.route_type == "empty":
        return QueryResult("empty", EMPTY)
    if plan.route_type == "fallback":
        return QueryResult("fallback", FALLBACK, notes=sorted(TOOLS))
    generated = plan.route_type == "generated_sparql"
    try:
        graph = kg() if callable(kg) else kg
        result = run_tool(graph, plan.intent, plan.slots)
        # A result is capped at 50 rows: it is collected once and said from there.
        rows = string_rows(result.rows)
        local = graph.spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in result.rows.columns))
        said = answers.summary(local) if generated else answers.answer(local, plan.intent, list(plan.slots))
        return QueryResult(plan.route_type, _text(said), rows=rows, notes=[plan.intent])
    except Exception as error:
        return QueryResult("generated_sparql" if generated else "tool_error", GENERATED_ERROR if generated else TOOL_ERROR, notes=[str(error)])


#: Intents of two slots.
PAIRS = ("pair_relations", "fs_pair")
_ANSWER = "_q array<string>, answer string, rows array<map<string,string>>, _note string, intent string"


def answer_questions(kg: KnowledgeGraph | Callable[[], KnowledgeGraph], questions: DataFrame, column: str = "question") -> DataFrame:
    """The questions of a table with mode, intent, slots, answer, rows and notes,
    as ``answer_question`` gives them one by one.

    Routes and the labels that slots may mean are written first, each text once;
    lookups read them. Names meet labels through the index of labels and facts by
    their nodes, so no question meets all labels; the caps of candidates and rows
    hold for each question. A null question is an empty one. A graph that cannot
    be loaded gives the error modes."""
    taken = {c.lower() for c in questions.columns}
    for name in ("mode", "intent", "slots", "answer", "rows", "notes"):
        if name in taken:
            raise ValueError(f"the table of questions has a column {name} already")
    spark = questions.sparkSession
    base = folder(spark, "questions")
    routed = _written(route_questions(questions, column), f"{base}/routed")
    asked = _written(routed.where(F.col("route_type").isin("tool", "generated_sparql")).select("intent", F.col("slots").alias("_q")).distinct(), f"{base}/asked")
    intents = [r.intent for r in asked.select("intent").distinct().collect()]  # of the fixed fifteen
    told, failed = spark.createDataFrame([], _ANSWER), None
    try:
        graph = kg() if callable(kg) else kg
        matches = _written(graph.indexed().asked(asked.select(F.explode("_q").alias("text")).distinct()), f"{base}/matches")
        for intent in sorted(intents):
            slots = asked.where(F.col("intent") == intent).select("_q")
            rows = (TOOLS | TEMPLATES)[intent](graph, *lookups.asked(graph, slots, matches)[: 1 + (intent in PAIRS)])
            said = answers.answer_each(rows, intent, slots, intent in TEMPLATES)
            told = told.unionByName(said.select("_q", "answer", "rows", F.lit(intent).alias("_note"), F.lit(intent).alias("intent")))
    except Exception as error:
        told, failed = spark.createDataFrame([], _ANSWER), str(error)
    told = told.select("_q", "answer", "rows", "_note", F.col("intent").alias("_i"))
    joined = routed.join(told, (F.col("intent") == F.col("_i")) & (F.col("slots") == F.col("_q")), "left")
    kind, generated = F.col("route_type"), F.col("route_type") == "generated_sparql"
    plain = F.when(kind == "empty", EMPTY).when(kind == "fallback", FALLBACK)
    error = F.when(generated, GENERATED_ERROR).otherwise(TOOL_ERROR)
    mode = F.when(kind.isin("empty", "fallback") | generated, kind).otherwise(F.lit("tool" if failed is None else "tool_error"))
    none = F.array().cast("array<string>")
    notes = F.when(kind == "fallback", F.array(*[F.lit(t) for t in sorted(TOOLS)])).when(kind == "empty", none).otherwise(F.array(F.col("_note") if failed is None else F.lit(failed)))
    return joined.select(*questions.columns, mode.alias("mode"), "intent", "slots", F.coalesce(plain, "answer", error).alias("answer"), F.coalesce("rows", F.array().cast("array<map<string,string>>")).alias("rows"), notes.alias("notes"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_sparql(kg: KnowledgeGraph, text: str) -> ToolResult:
    """Ad-hoc SELECT text; a blank text is an error."""
    from lattica.plans.sparql import select

    if not text.strip():
        raise ValueError("the query is empty")
    return ToolResult("run_sparql", select(kg, text), sparql=text.strip())


def health(kg: KnowledgeGraph) -> DataFrame:
    """(table, rows) of what a graph holds."""
    from functools import reduce

    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in (("facts", kg.facts), ("labels", kg.labels), ("types", kg.types), ("others", kg.others))]
    return reduce(DataFrame.unionByName, counts)

"""From rows to the text of an answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as tx

#: What each intent shows (column and name), and the sentences.
SHOWN = {
    "courtesy_name": ("courtesyName", "字"),
    "art_name": ("artName", "号"),
    "birth_death": (None, "生卒年"),
    "teacher_relations": ("teacherLabel", "师承对象"),
    "family_relations": (None, "亲属关系对象"),
    "social_relations": ("friendLabel", "交游对象"),
    "school_membership": ("schoolLabel", "所属流派"),
    "school_founder": ("founderLabel", "开创者"),
    "pair_relations": (None, "人物关系"),
    "person_labels": ("label", "候选标签"),
}
NO_ROWS = "图谱中暂时没有查到与“{slot}”相关的结果。"
NO_VALUES = "图谱里查到了“{slot}”的候选实体，但还没有可展示的{name}信息。"
VALUES = "“{slot}”的{name}信息包括：{shown}"
LABELS = "图谱里与“{slot}”相关的候选标签有：{shown}"
NO_LABELS = "暂无候选标签"
GENERATED = "系统已根据 few-shot 示例生成并执行 SPARQL，当前返回结果包括：{shown}"
GENERATED_EMPTY = "系统已经生成并执行了候选 SPARQL，但当前结果集为空。"
SUMMARY_EMPTY = "结果为空"
MOST_VALUES, MOST_ROWS = 10, 5
BETWEEN, INSIDE, PART = "、", "，", "；"


def _value(intent: str, columns: list[str], get: Callable[[str], Column] = F.col) -> Column:
    """What a row shows, null for nothing."""
    of = lambda c: tx.strip(F.coalesce(get(c).cast("string"), F.lit(""))) if c in columns else F.lit("")
    if intent == "birth_death":
        birth, death = of("birthYear"), of("deathYear")
        return F.when((birth != "") | (death != ""), F.btrim(F.concat(birth, F.lit(" - "), death), F.lit(" -")))
    if intent == "family_relations":
        relative, kind = of("relativeLabel"), of("relationType")
        return F.when(relative != "", F.when(kind != "", F.concat(kind, F.lit("："), relative)).otherwise(relative))
    if intent == "pair_relations":
        shown = tx.first_nonempty(of("relationLabel"), of("relation"))
        return F.when(shown.isNotNull(), F.concat(of("direction"), F.lit("："), shown))
    return F.nullif(of(SHOWN[intent][0]), F.lit(""))


#: Intents whose repeated values are all shown.
REPEATED = ("birth_death", "family_relations", "pair_relations")


def values(rows: DataFrame, intent: str) -> DataFrame:
    """(position, value): what a capped result shows, in its order; repeated
    values once, at their first place, where the intent asks for that."""
    order = Window.orderBy(*rows.columns)  # a result has 50 rows at most
    placed = rows.select(F.row_number().over(order).alias("position"), _value(intent, rows.columns).alias("value")).where("value is not null")
    if intent in REPEATED:
        return placed
    return placed.groupBy("value").agg(F.min("position").alias("position")).select("position", "value")


def _in_order(listed: str, most: int) -> Column:
    """The values of collected (position, value), the first ``most``."""
    return F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", listed))), lambda x: x[listed]), 1, most)


def _sentence(intent: str, n: Column, v: Column, slot: Column) -> Column:
    shown = F.array_join(v, BETWEEN)

    def said(sentence: str) -> Column:
        parts = re.split(r"(\{\w+\})", sentence.replace("{name}", SHOWN[intent][1]))
        return F.concat(*[slot if p == "{slot}" else shown if p == "{shown}" else F.lit(p) for p in parts])

    if intent == "person_labels":
        shown = F.when(F.size(v) == 0, F.lit(NO_LABELS)).otherwise(shown)
        some = said(LABELS)
    else:
        some = F.when(F.size(v) == 0, said(NO_VALUES)).otherwise(said(VALUES))
    return F.when(n == 0, said(NO_ROWS)).otherwise(some)


def answer(rows: DataFrame, intent: str, slots: list[str]) -> DataFrame:
    """One row with the answer's text."""
    listed = values(rows, intent).agg(_in_order("value", MOST_VALUES).alias("v"))
    both = rows.agg(F.count("*").alias("n")).crossJoin(listed)  # one row each
    return both.select(_sentence(intent, F.col("n"), F.col("v"), F.lit(BETWEEN.join(slots))).alias("answer"))


def answer_each(rows: DataFrame, intent: str, slots: DataFrame, generated: bool = False) -> DataFrame:
    """(_q, answer, rows): an answer for each of ``slots`` (_q) from its rows
    (see ``lookups.Asked``), which come as maps. A question has 50 rows at most,
    so they are put in order and read as one array."""
    columns = [c for c in rows.columns if c != "_q"]
    whole = rows.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))
    shown = _bound(columns, lambda r: lambda c: r[c]) if generated else lambda r: _value(intent, columns, lambda c: r[c])
    listed = F.filter(F.transform(F.slice("_rows", 1, MOST_ROWS) if generated else F.col("_rows"), shown), lambda v: v.isNotNull())
    if not generated:
        listed = F.slice(listed if intent in REPEATED else F.array_distinct(listed), 1, MOST_VALUES)
    maps = F.transform("_rows", lambda r: F.create_map(*[x for c in columns for x in (F.lit(c), r[c])]))
    told = slots.join(whole.select("_q", listed.alias("v"), maps.alias("rows")), "_q", "left")
    n, v = F.coalesce(F.size("rows"), F.lit(0)), F.coalesce("v", F.array().cast("array<string>"))
    text = _told(n, v) if generated else _sentence(intent, n, v, F.array_join("_q", BETWEEN))
    return told.select("_q", text.alias("answer"), F.coalesce("rows", F.array().cast("array<map<string,string>>")).alias("rows"))


def _bound(columns: list[str], of: Callable) -> Callable[..., Column]:
    """The bound columns of a row as text."""
    def text(row) -> Column:
        get = of(row)
        parts = F.filter(F.array(*[F.when(F.coalesce(get(c), F.lit("")) != "", F.concat(F.lit(f"{c}="), get(c))) for c in columns]), lambda x: x.isNotNull())
        return F.array_join(parts, INSIDE)

    return text


def _told(n: Column, texts: Column) -> Column:
    joined = F.array_join(F.filter(texts, lambda t: t != ""), PART)
    text = F.when(joined == "", F.lit(SUMMARY_EMPTY)).otherwise(joined)
    return F.when(n == 0, F.lit(GENERATED_EMPTY)).otherwise(F.concat(F.lit(GENERATED.removesuffix("{shown}")), text))


def summary(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row with the text of the first rows' bound columns."""
    text = _bound(rows.columns, lambda _: F.col)(None)
    place = F.row_number().over(Window.orderBy(*(order or rows.columns)))
    first = rows.select(place.alias("position"), text.alias("text")).where(F.col("position") <= MOST_ROWS)
    got = first.agg(_in_order("text", MOST_ROWS).alias("t"), F.count("*").alias("n"))
    return got.select(_told(F.col("n"), F.col("t")).alias("answer"))


def table(*results: DataFrame) -> DataFrame:
    """Rows of different shapes in one table; a column that a row lacks is ''."""
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])

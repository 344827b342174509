"""From result rows to a property graph: nodes, edges, meta and layout.

The first rule that fits a row gives its edge. Nodes and edges are kept once,
a node with the type of its first appearance. Rows come in the order of all
their columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import first_nonempty, strip

#: The rules in order (source and target column, their types, the
#: edge's label or None for the row's own, and the label if there is none).
RULES = (
    ("sourceLabel", "targetLabel", "person", "person", None, "直接关系"),
    ("label", "teacherLabel", "person", "person", "师承", ""),
    ("label", "relativeLabel", "person", "person", None, "亲属"),
    ("label", "friendLabel", "person", "person", "交游", ""),
    ("label", "schoolLabel", "person", "school", "所属流派", ""),
    ("founderLabel", "schoolLabel", "person", "school", "开创", ""),
    ("label", "relatedLabel", "person", "person", "关联", ""),
)
OWN_LABELS = ("relationLabel", "relationType", "relation")
DEFAULT_LABEL = "关联"
PERSON_WORDS = ("person", "teacher", "friend", "relative", "founder", "source", "target", "related")
SIZE_PERSON, SIZE_OTHER = 22, 18
WARN_NO_EDGE = "结果表格里暂未识别到标准关系字段，当前只能抽取到零散节点。"
WARN_FEW = "节点数量过少，当前无法形成有效的人物关系网络。"
WARN_LOOSE = "已有多个节点，但没有识别到边。后续需要与成员 C 对齐字段名。"
WIDTH, HEIGHT, LEAST_RADIUS, MARGIN = 760, 420, 90, 72

_LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "source_type", "target", "target_type", "label")])


def node_type(column: str) -> str:
    """The type that a column's name tells."""
    name = column.lower()
    if "school" in name:
        return "school"
    if "place" in name:
        return "place"
    return "person" if any(w in name for w in PERSON_WORDS) else "unknown"


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame


def _links(rows: DataFrame) -> DataFrame:
    """(position, link): the link of each row by the first rule that fits."""
    columns = rows.columns

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("")

    own = first_nonempty(*[text(c) for c in OWN_LABELS])

    def link(a: Column, a_type: str, b: Column, b_type: str, label: Column) -> Column:
        parts = (a, F.lit(a_type), b, F.lit(b_type), label)
        return F.struct(*[p.cast("string").alias(f.name) for p, f in zip(parts, _LINK.fields)])

    fits = [
        F.when((text(a) != "") & (text(b) != ""), link(text(a), ta, text(b), tb, F.coalesce(own, F.lit(default)) if label is None else F.lit(label)))
        for a, b, ta, tb, label, default in RULES
        if a in columns and b in columns
    ]
    keys = sorted(c for c in columns if c.lower().endswith("label"))
    if len(keys) >= 2:
        a, b = keys[:2]
        fits.append(link(text(a), node_type(a), text(b), node_type(b), F.coalesce(own, F.lit(DEFAULT_LABEL))))
    elif keys:
        fits.append(link(text(keys[0]), node_type(keys[0]), F.lit(""), "", F.lit("")))
    found = F.coalesce(*fits) if fits else F.lit(None).cast(_LINK)
    order = Window.orderBy(*columns)  # shown results have 50 rows at most
    return rows.select(F.row_number().over(order).alias("position"), found.alias("link")).select("position", "link.*")


def property_graph(rows: DataFrame, source: str = "query") -> PropertyGraph:
    links = _links(rows)
    trim = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    ends = links.select(trim("source").alias("id"), F.col("source_type").alias("type"), (2 * F.col("position")).alias("at")).unionByName(
        links.select(trim("target").alias("id"), F.col("target_type").alias("type"), (2 * F.col("position") + 1).alias("at"))
    )
    kept = ends.where("id <> ''").groupBy("id").agg(F.min_by("type", "at").alias("type"), F.min("at").alias("first"))
    nodes = kept.select("id", F.col("id").alias("label"), "type", F.col("type").alias("group"), F.when(F.col("type") == "person", SIZE_PERSON).otherwise(SIZE_OTHER).alias("size"), "first")
    drawn = links.select(trim("source").alias("source"), trim("target").alias("target"), first_nonempty(F.col("label"), F.lit(DEFAULT_LABEL)).alias("label"))
    edges = drawn.where("source <> '' AND target <> '' AND source <> target").distinct()
    edges = edges.select(F.concat_ws("::", "source", "target", "label").alias("id"), "source", "target", "label", F.col("label").alias("relationType"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(rows, "rowCount").crossJoin(n(nodes, "nodeCount")).crossJoin(n(edges, "edgeCount"))  # one row each
    r, v, e = F.col("rowCount"), F.col("nodeCount"), F.col("edgeCount")
    warnings = F.array(F.when((r > 0) & (e == 0), WARN_NO_EDGE), F.when((v > 0) & (v < 2), WARN_FEW), F.when((v >= 2) & (e == 0), WARN_LOOSE))
    meta = counts.select(F.lit(source).alias("source"), "rowCount", "nodeCount", "edgeCount", F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))
    return PropertyGraph(nodes, edges, meta)


def circular_layout(nodes: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """The nodes on a circle, clockwise from the top in order of appearance; a
    single one in the centre."""
    radius = max(LEAST_RADIUS, min(width, height) / 2 - MARGIN)
    index = F.row_number().over(Window.orderBy("first")) - 1
    total = F.count("*").over(Window.partitionBy())
    placed = nodes.select("*", index.alias("_i"), total.alias("_n"))
    angle = F.pi() * 2 * F.col("_i") / F.col("_n") - F.pi() / 2
    at = lambda centre, turn: F.when(F.col("_n") == 1, F.lit(centre)).otherwise(F.lit(centre) + F.lit(float(radius)) * turn(angle))
    return placed.select(*nodes.columns, at(width / 2, F.cos).alias("x"), at(height / 2, F.sin).alias("y"))

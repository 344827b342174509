"""Nodes that owl:sameAs makes one: classes, and the graph over them.

The classes are the connected components of the statements. In a round every
node points to its smallest neighbour (or itself), the chains of pointers are
followed by doubling, and the edges are rewritten to their ends, so the graph
shrinks by whole chains at once. Tables of a round are written; a hub's edges are
aggregated where they are before they meet.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.lineage import folder
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import OWL

SAME = OWL + "sameAs"
#: Rounds after which something must be wrong: nodes halve at least.
MOST_ROUNDS = 64


class _Tables:
    """Tables of one computation, in a folder that goes with the driver."""

    def __init__(self, df: DataFrame):
        self.spark, self.base, self.n = df.sparkSession, folder(df.sparkSession, "same-as"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _through(rows: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """``column`` replaced by what it points to, if it points anywhere."""
    ends = pointers.select(F.col("node").alias("_from"), F.col("to").alias("_to"))
    joined = rows.join(ends, F.col(column) == F.col("_from"), "left")
    return joined.select(*[F.coalesce("_to", column).alias(c) if c == column else F.col(c) for c in rows.columns])


def classes(edges: DataFrame) -> DataFrame:
    """(node, canonical) of every node of edges (a, b): the smallest node, in
    code-point order, that it reaches. Nulls and loops say nothing."""
    tables = _Tables(edges)
    given = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    edges = tables.keep(given.where(F.col("a") != F.col("b")).distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = tables.keep(ends.select("node", F.col("node").alias("canonical")))
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            return known
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = tables.keep(both.groupBy("a").agg(F.min("b").alias("least")).where(F.col("least") < F.col("a")).select(F.col("a").alias("node"), F.col("least").alias("to")))
        while True:  # chains lead to smaller nodes, so they end, and halve each time
            onward = tables.keep(_through(pointers.withColumn("was", F.col("to")), "to", pointers))
            pointers = onward.select("node", "to")
            if onward.where(F.col("was") != F.col("to")).isEmpty():
                break
        known = tables.keep(_through(known, "canonical", pointers))
        edges = tables.keep(_through(_through(edges, "a", pointers), "b", pointers).where(F.col("a") != F.col("b")).distinct())
    raise RuntimeError(f"no end of the classes after {MOST_ROUNDS} rounds")


def same_as(kg: KnowledgeGraph) -> DataFrame:
    """(node, canonical) by the graph's sameAs statements."""
    said = kg.others.where((F.col("p") == SAME) & (F.col("o_kind") != "literal"))
    return classes(said.select(F.col("s").alias("a"), F.col("o").alias("b")))


def rewritten(facts: DataFrame, known: DataFrame) -> DataFrame:
    """The facts with canonical ends, the given ends as ``was_source`` and
    ``was_target`` (null where nothing changed), and ``was_rewritten``: one pass
    for what the merged graph and its provenance have of the facts."""
    pointers = known.where(F.col("node") != F.col("canonical"))
    ends = lambda c: pointers.select(F.col("node").alias(f"_{c}"), F.col("canonical").alias(f"_to_{c}"))
    met = facts.join(ends("source"), F.col("source") == F.col("_source"), "left").join(ends("target"), F.col("target") == F.col("_target"), "left")
    hit = F.col("_source").isNotNull() | F.col("_target").isNotNull()
    made = [F.coalesce(f"_to_{c}", c).alias(c) if c in ("source", "target") else F.col(c) for c in facts.columns]
    return met.select(*made, *[F.when(hit, F.col(c)).alias(f"was_{c}") for c in ("source", "target")], hit.alias("was_rewritten"))


def merged(kg: KnowledgeGraph, known: DataFrame | None = None) -> tuple[KnowledgeGraph, DataFrame]:
    """The graph with canonical nodes in place of all of their classes, and the
    provenance (fact_id, source, target) of the facts that were rewritten. Facts
    keep their ids, so what says the same under two names stays two facts."""
    known = same_as(kg) if known is None else known
    pointers = known.where(F.col("node") != F.col("canonical")).select("node", F.col("canonical").alias("to"))
    both = rewritten(kg.facts, known)
    facts = both.select(kg.facts.columns)
    provenance = both.where("was_rewritten").select("fact_id", F.col("was_source").alias("source"), F.col("was_target").alias("target"))
    nodes = lambda df: _through(df, "node", pointers).distinct()
    others = kg.others.where(F.col("p") != SAME)
    others = _through(others, "s", pointers)
    objects = _through(others.where(F.col("o_kind") != "literal"), "o", pointers)
    others = objects.unionByName(others.where(F.col("o_kind") == "literal")).distinct()
    return replace(kg, facts=facts, labels=nodes(kg.labels), types=nodes(kg.types), others=others, index=None), provenance

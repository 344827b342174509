"""Relational tables seen as a knowledge graph.

Customers and suppliers are persons, nations schools, market segments and order
priorities courtesy and art names; orders and lineitems give the facts. Every
relation type is a branch of one union, so a query for one type reads only the
tables of its branch (the filter folds the others away).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import TRIPLES, Vocabulary

NODE = "urn:star:"

#: Relation types with a label of their own.
LABELLED = ("hasCourtesyName", "hasArtName", "bornIn", "diedIn", "hasTeacher", "fatherOf", "belongsToSchool", "foundsSchool")


def node(kind: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{NODE}{kind}/"), key.cast("string"))


def star_graph(spark: SparkSession, sf_dir: str, vocabulary: Vocabulary = Vocabulary()) -> KnowledgeGraph:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer, orders = table("customer"), table("orders")
    union = lambda tables: reduce(DataFrame.unionByName, tables)

    def fact(rel: str, rows: DataFrame, source: Column, target: Column) -> DataFrame:
        named = rows.select(F.lit(vocabulary(rel)).alias("rel_type"), source.alias("source"), target.alias("target"))
        return named.select(F.concat_ws("|", "rel_type", "source", "target").alias("fact_id"), "rel_type", "source", "target", F.lit("iri").alias("target_kind"))

    spans = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    taught = table("lineitem").select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    next_in_nation = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    friends = customer.select("c_custkey", next_in_nation.alias("friend")).where("friend is not null")
    facts = union([
        fact("hasCourtesyName", customer, node("customer", "c_custkey"), node("segment", "c_mktsegment")),
        fact("hasArtName", orders.select("o_custkey", "o_orderpriority").distinct(), node("customer", "o_custkey"), node("priority", "o_orderpriority")),
        fact("bornIn", spans, node("customer", "o_custkey"), node("year", F.year("first"))),
        fact("diedIn", spans, node("customer", "o_custkey"), node("year", F.year("last"))),
        fact("hasTeacher", taught, node("customer", "o_custkey"), node("supplier", "l_suppkey")),
        fact("fatherOf", customer.where("c_custkey >= 1"), node("customer", F.floor(F.col("c_custkey") / 2)), node("customer", "c_custkey")),
        fact("hasFriend", friends, node("customer", "c_custkey"), node("customer", "friend")),
        fact("belongsToSchool", customer, node("customer", "c_custkey"), node("nation", "c_nationkey")),
        fact("foundsSchool", table("supplier"), node("supplier", "s_suppkey"), node("nation", "s_nationkey")),
    ])

    years = orders.select(F.year("o_orderdate").alias("y")).distinct()
    kinds = [
        ("customer", customer.select("c_custkey", "c_name"), "Person"),
        ("supplier", table("supplier").select("s_suppkey", "s_name"), "Person"),
        ("nation", table("nation").select("n_nationkey", "n_name"), "School"),
        ("segment", customer.select("c_mktsegment", F.col("c_mktsegment").alias("name")).distinct(), "CourtesyName"),
        ("priority", orders.select("o_orderpriority", F.col("o_orderpriority").alias("name")).distinct(), "ArtName"),
        ("year", years.select("y", F.when(F.col("y") % 2 == 0, F.col("y").cast("string")).alias("name")), "Time"),
    ]
    nodes = [(rows.select(node(kind, rows.columns[0]).alias("node"), F.col(rows.columns[1]).alias("label")), cls) for kind, rows, cls in kinds]
    types = union([rows.select("node", F.lit(vocabulary(cls)).alias("cls")) for rows, cls in nodes])
    relations = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in LABELLED])).alias("label"))
    named = [rows.where("label is not null") for rows, _ in nodes] + [relations.select(F.concat(F.lit(vocabulary("")), "label").alias("node"), "label")]
    labels = union(named).withColumn("lang", F.lit(None).cast("string"))

    even = spans.where("o_custkey % 2 = 0")

    def literal(rel: str, day: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return even.select(
            node("customer", "o_custkey").alias("s"), F.lit("iri").alias("s_kind"), F.lit(vocabulary(rel)).alias("p"),
            F.date_format(day, "yyyy-MM").alias("o"), F.lit("literal").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"),
        )

    others = literal("bornIn", "first").unionByName(literal("diedIn", "last")).select(TRIPLES.fieldNames())
    # Facts are named by their type and ends, of which no branch has two alike.
    return KnowledgeGraph(facts, labels, types, others, vocabulary, single=True)

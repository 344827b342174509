"""A knowledge graph as tables.

Facts are reified: a node of class Relation with a type, a source and a target.
Queries read ``facts`` (one row a fact) in place of joining four triples, and
``facts`` is stored partitioned by relation type, so a query for one type reads
its files only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.plans.labels import LabelIndex
from lattica.plans.model import FACTS, LABEL, LABELS, TRIPLES, TYPE, TYPES, Vocabulary


@dataclass(frozen=True)
class KnowledgeGraph:
    facts: DataFrame
    labels: DataFrame
    types: DataFrame
    others: DataFrame
    vocabulary: Vocabulary = Vocabulary()
    index: LabelIndex | None = None
    #: ``graph`` where the tables hold many graphs side by side (see ``Dataset``).
    keys: tuple[str, ...] = ()
    #: Whether ``others`` holds the statements of nodes that are no whole fact.
    loose: bool = False
    #: Whether each fact is one row of ``facts``, so that its parts need no DISTINCT.
    single: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    @classmethod
    def from_triples(cls, triples: DataFrame, vocabulary: Vocabulary = Vocabulary(), keys: tuple[str, ...] = (), loose: bool = False) -> KnowledgeGraph:
        """``triples`` is a set of statements (see ``TRIPLES``). With ``keys`` the
        statements of each key are a graph of their own. A node without class,
        type, source or target is no fact: what it states of them is left out, or
        kept among the others if ``loose``."""
        v = vocabulary
        parts = {"rel_type": v("relationType"), "source": v("sourceEntity"), "target": v("targetEntity")}
        of = lambda p, value: F.collect_set(F.when(F.col("p") == p, value))
        # One shuffle by subject; several values of a part give a fact for each combination.
        nodes = (
            triples.where(F.col("p").isin(*parts.values()) | ((F.col("p") == TYPE) & (F.col("o") == v("Relation"))))
            .groupBy("s", *keys)
            .agg(F.max(F.col("p") == TYPE).alias("is_fact"), *[of(p, F.struct("o", "o_kind")).alias(c) for c, p in parts.items()])
            .where("is_fact")
        )
        for c in parts:
            nodes = nodes.withColumn(c, F.explode(c))
        facts = nodes.select(F.col("s").alias("fact_id"), F.col("rel_type.o").alias("rel_type"), F.col("source.o").alias("source"), F.col("target.o").alias("target"), F.col("target.o_kind").alias("target_kind"), *keys)
        labels = triples.where((F.col("p") == LABEL) & (F.col("o_kind") == "literal")).select(F.col("s").alias("node"), F.col("o").alias("label"), F.col("o_lang").alias("lang"), *keys)
        types = triples.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("cls"), *keys)
        known = [TYPE, *parts.values()]
        others = triples.where(~F.col("p").isin(*known) & ~((F.col("p") == LABEL) & (F.col("o_kind") == "literal")))
        if loose:
            parted = triples.where(F.col("p").isin(*parts.values()) | ((F.col("p") == TYPE) & (F.col("o") == v("Relation"))))
            whole = facts.select(F.col("fact_id").alias("s"), *keys)
            others = others.unionByName(parted.join(whole, ["s", *keys], "left_anti").select(others.columns))
        return cls(facts, labels, types, others, vocabulary, keys=keys, loose=loose)

    @property
    def persons(self) -> DataFrame:
        """(node, label, lang) of labelled persons."""
        people = self.types.where(F.col("cls") == self.vocabulary("Person")).select("node").distinct()
        return self.labels.join(people, "node", "left_semi")

    def indexed(self) -> LabelIndex:
        """The stored index of labels, or one made within the plan."""
        return self.index or LabelIndex.of(self.labels, self.types.where(F.col("cls") == self.vocabulary("Person")).select("node"))

    def facts_of(self, name: str) -> DataFrame:
        return self.facts.where(F.col("rel_type") == self.vocabulary(name))

    def literals_of(self, name: str) -> DataFrame:
        """(node, value) of literals stated directly under a property."""
        return self.others.where((F.col("p") == self.vocabulary(name)) & (F.col("o_kind") == "literal")).select(F.col("s").alias("node"), F.col("o").alias("value"))

    def triples(self) -> DataFrame:
        """All statements, unfolded from the tables."""
        v, none, keys = self.vocabulary, F.lit(None).cast("string"), self.keys

        def made(df, s, p, o, kind="iri", lang=none):
            return df.select(*keys, s.alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), o.alias("o"), (F.lit(kind) if isinstance(kind, str) else kind).alias("o_kind"), none.alias("o_datatype"), lang.alias("o_lang"))

        c = F.col
        once = lambda *columns: self.facts.select(*columns, *keys) if self.single else self.facts.select(*columns, *keys).distinct()
        relation = self.types.where(c("cls") != v("Relation"))
        return (
            made(once("fact_id"), c("fact_id"), F.lit(TYPE), F.lit(v("Relation")))
            .unionByName(made(once("fact_id", "rel_type"), c("fact_id"), F.lit(v("relationType")), c("rel_type")))
            .unionByName(made(once("fact_id", "source"), c("fact_id"), F.lit(v("sourceEntity")), c("source")))
            .unionByName(made(once("fact_id", "target", "target_kind"), c("fact_id"), F.lit(v("targetEntity")), c("target"), c("target_kind")))
            .unionByName(made(relation, c("node"), F.lit(TYPE), c("cls")))
            .unionByName(made(self.labels, c("node"), F.lit(LABEL), c("label"), "literal", c("lang")))
            .unionByName(self.others.select(*TRIPLES.fieldNames(), *keys))
        )

    def persist(self) -> KnowledgeGraph:
        """Keep the tables in memory and on disk between queries."""
        return KnowledgeGraph(*[t.persist() for t in (self.facts, self.labels, self.types, self.others)], self.vocabulary, self.index, self.keys, self.loose, self.single)

    def write(self, path: str) -> None:
        self.facts.write.mode("overwrite").partitionBy(*self.keys, "rel_type").parquet(f"{path}/facts")
        self.labels.write.mode("overwrite").partitionBy(*self.keys).parquet(f"{path}/labels")
        self.types.write.mode("overwrite").partitionBy(*self.keys, "cls").parquet(f"{path}/types")
        self.others.write.mode("overwrite").partitionBy(*self.keys, "p").parquet(f"{path}/others")
        if not self.keys:  # lookups by label are for one graph
            self.indexed().write(f"{path}/index")

    @classmethod
    def read(cls, spark: SparkSession, path: str, vocabulary: Vocabulary = Vocabulary(), keys: tuple[str, ...] = (), loose: bool = False) -> KnowledgeGraph:
        def table(name, schema):
            schema = StructType([*schema.fields, *[StructField(k, StringType()) for k in keys]])
            return spark.read.schema(schema).parquet(f"{path}/{name}").select(schema.fieldNames())

        return cls(table("facts", FACTS), table("labels", LABELS), table("types", TYPES), table("others", TRIPLES), vocabulary, None if keys else LabelIndex.read(spark, f"{path}/index"), keys, loose)

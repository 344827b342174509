"""Named graphs beside each other.

Statements with a column ``graph`` are kept as tables like those of one graph,
with that column as their outermost storage partition: a pattern inside
``GRAPH <a>`` reads the files of that graph, one inside ``GRAPH ?g`` joins within
graphs in a single plan, whatever their number. The default graph is the merge
of all; ``FROM`` makes another one of the graphs that it names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import TRIPLES, Vocabulary

QUADS = StructType([*TRIPLES.fields, StructField("graph", StringType())])
_KEYS = ("graph",)


@dataclass(frozen=True)
class Dataset:
    quads: DataFrame
    default: KnowledgeGraph
    named: KnowledgeGraph

    @classmethod
    def from_quads(cls, quads: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> Dataset:
        """``quads`` is a set of statements with a graph each (see ``QUADS``); those
        of a null graph belong to the default graph only."""
        named = quads.where("graph is not null")
        return cls(quads, _merged(quads, vocabulary), KnowledgeGraph.from_triples(named, vocabulary, _KEYS, loose=True))

    def names(self) -> DataFrame:
        """(graph) of the named graphs; one without statements does not exist."""
        return self.quads.where("graph is not null").select("graph").distinct()

    def one(self, name: str) -> KnowledgeGraph:
        """A named graph by itself; an unknown name is an empty graph."""
        own = self._kept(F.col("graph") == name)
        return replace(own, keys=(), **{t: getattr(own, t).drop("graph") for t in _TABLES})

    def restricted(self, default: list[str], named: list[str]) -> Dataset:
        """The dataset of FROM (the merge of ``default``) and FROM NAMED."""
        merged = _merged(self.quads.where(_among(default)), self.named.vocabulary)
        return Dataset(self.quads.where(_among(named)), merged, self._kept(_among(named)))

    def _kept(self, condition: Column) -> KnowledgeGraph:
        return replace(self.named, **{t: getattr(self.named, t).where(condition) for t in _TABLES})

    def write(self, path: str) -> None:
        """The statements and both forms of them, so that queries derive none."""
        self.quads.select(QUADS.fieldNames()).write.mode("overwrite").partitionBy("graph", "p").parquet(f"{path}/quads")
        self.default.write(f"{path}/default")
        self.named.write(f"{path}/named")

    @classmethod
    def read(cls, spark: SparkSession, path: str, vocabulary: Vocabulary = Vocabulary()) -> Dataset:
        quads = spark.read.schema(QUADS).parquet(f"{path}/quads").select(QUADS.fieldNames())
        return cls(quads, KnowledgeGraph.read(spark, f"{path}/default", vocabulary, loose=True), KnowledgeGraph.read(spark, f"{path}/named", vocabulary, _KEYS, loose=True))


_TABLES = ("facts", "labels", "types", "others")


def _among(names: list[str]) -> Column:
    return F.col("graph").isin(*names) if names else F.lit(False)


def _merged(quads: DataFrame, vocabulary: Vocabulary) -> KnowledgeGraph:
    """Facts may have their parts in several graphs, so a merge starts from
    statements; one that several graphs make counts once."""
    return KnowledgeGraph.from_triples(quads.select(TRIPLES.fieldNames()).distinct(), vocabulary, loose=True)


def named(graphs: dict[str, DataFrame]) -> DataFrame:
    """The statements of several sources, each a graph of the given name."""
    return reduce(DataFrame.unionByName, [t.select(*TRIPLES.fieldNames(), F.lit(name).alias("graph")) for name, t in graphs.items()])

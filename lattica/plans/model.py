"""Vocabulary, schemas and result records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Public namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

TYPE = RDF + "type"
LABEL = RDFS + "label"

#: The default namespace of relation types and classes; graphs that use another
#: one name it in their Vocabulary.
DEFAULT_NAMESPACE = "urn:lattica:kg#"


@dataclass(frozen=True)
class Vocabulary:
    """The names a graph uses. ``prefix`` is what queries abbreviate it to."""

    namespace: str = DEFAULT_NAMESPACE
    prefix: str = "kg"

    def __call__(self, name: str) -> str:
        return self.namespace + name

    @property
    def prefixes(self) -> dict[str, str]:
        return {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, self.prefix: self.namespace}

    def header(self) -> str:
        return "\n".join(f"PREFIX {k}: <{v}>" for k, v in self.prefixes.items())


def _schema(names: str, kind: T.DataType | None = None, **others: T.DataType) -> T.StructType:
    """A struct of strings but for the named columns."""
    return T.StructType([T.StructField(n, others.get(n, kind or T.StringType())) for n in names.split()])


TRIPLES = _schema("s s_kind p o o_kind o_datatype o_lang")
FACTS = _schema("fact_id rel_type source target target_kind")
LABELS = _schema("node label lang")
TYPES = _schema("node cls")

#: Schemas of the JSON deliverables that graphs are built from.
_LONG, _STRINGS = T.LongType(), T.ArrayType(T.StringType())
CHAPTERS = _schema("chapter_id title source_file start_offset end_offset text", start_offset=_LONG, end_offset=_LONG)
PASSAGES = _schema("person_name source_chapter_id passage_id text")
ENTITIES = _schema(
    "entity_id name type source_passage_id attributes", attributes=_schema("courtesy_name art_name birth_year death_year", courtesy_name=_STRINGS, art_name=_STRINGS)
)
RELATIONS = _schema("relation_id subject predicate object relation_type source_passage_id evidence")

ENTITY = _schema("name category evidence")
ATTRIBUTE = _schema("subject attribute value evidence")
RELATION = _schema("source relation target evidence")
PAYLOAD = _schema("entities attributes relations", entities=T.ArrayType(ENTITY), attributes=T.ArrayType(ATTRIBUTE), relations=T.ArrayType(RELATION))
RECORDS = _schema("record_id person_name source_text text_length", text_length=_LONG)
EXTRACTED = T.StructType([*RECORDS.fields, *PAYLOAD.fields])
QUERY_RESULT = _schema("mode answer sparql rows notes", rows=T.ArrayType(T.MapType(T.StringType(), T.StringType())), notes=_STRINGS)


@dataclass(frozen=True)
class ToolResult:
    """A named query and its lazy rows; ``sparql`` says the same as text."""

    name: str
    rows: DataFrame
    note: str = ""
    sparql: str | None = None

    def collect(self) -> list[dict[str, str]]:
        return string_rows(self.rows)


@dataclass
class QueryResult:
    mode: str
    answer: str
    sparql: str | None = None
    rows: list[dict[str, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def string_rows(rows: DataFrame) -> list[dict[str, str]]:
    """The rows of a capped result as dicts of strings; unbound values are ''."""
    return [{k: "" if v is None else str(v) for k, v in r.asDict().items()} for r in rows.collect()]

"""SPARQL SELECT over a knowledge graph, compiled to DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lattica.plans.dataset import Dataset
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.sparql.compiler import compile_select
from lattica.plans.sparql.syntax import SparqlError, parse

__all__ = ["SparqlError", "parse", "select"]


def select(kg: KnowledgeGraph | Dataset, text: str) -> DataFrame:
    """The rows of a SELECT query as string columns, unbound values as ''."""
    return compile_select(kg, parse(text))

"""Where a project's files are, and which of them are there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The files of a project below its folder, by group.
FILES = {
    "source": {
        "raw_text_dir": "data/source/raw_text",
        "clean_text_dir": "data/source/clean_text",
        "chapter_split_json": "data/source/chapter_split.json",
        "person_passages_json": "data/source/person_passages.json",
    },
    "intermediate": {
        "entities_json": "data/intermediate/entities.json",
        "relations_json": "data/intermediate/relations.json",
        "extraction_prompts_md": "data/intermediate/extraction_prompts.md",
        "evaluation_samples_json": "data/intermediate/evaluation_samples.json",
    },
    "graph": {
        "schema_ttl": "data/kg/schema.ttl",
        "core_ttl": "data/kg/core.ttl",
        "aligned_ttl": "data/kg/aligned.ttl",
        "alignment_rules_md": "data/kg/alignment_rules.md",
    },
    "application": {
        "query_tools_py": "src/tools.py",
        "sparql_examples_md": "data/examples/fewshot_sparql.md",
        "frontend_html": "templates/index.html",
        "frontend_css": "static/styles.css",
        "demo_script_md": "docs/demo_script.md",
    },
}
GRAPH_FILES = ("schema_ttl", "core_ttl", "aligned_ttl")


def exists(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@dataclass(frozen=True)
class Catalog:
    base: str

    def path(self, item: str) -> str:
        for items in FILES.values():
            if item in items:
                return f"{self.base}/{items[item]}"
        raise KeyError(item)

    def graph_files(self) -> list[str]:
        return [self.path(f) for f in GRAPH_FILES]

    def audit(self, spark: SparkSession) -> DataFrame:
        """(group, item, exists) of every file."""
        rows = [(g, i, exists(spark, self.path(i))) for g, items in FILES.items() for i in items]
        return spark.createDataFrame(rows, "group string, item string, exists boolean")

"""JSON arrays of records in, JSON out."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.model import CHAPTERS, ENTITIES, PASSAGES, RECORDS, RELATIONS

DELIVERABLES = {"chapters": CHAPTERS, "passages": PASSAGES, "entities": ENTITIES, "relations": RELATIONS}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Person records. Values are read as text first, so that a number given as
    a string, or a string as a number, is taken; a length that is no number, or
    a missing field, is an error when the rows are read."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in RECORDS.fields])
    rows = spark.read.schema(raw).option("multiLine", True).option("mode", "FAILFAST").json(path)
    present = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a record lacks {c}")).cast("string")).otherwise(F.col(c))
    return rows.select(*[present(f.name).cast(f.dataType).alias(f.name) for f in RECORDS.fields])


def read_deliverable(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(DELIVERABLES[kind]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in parallel, overwriting; nothing is committed
    unless every task succeeds."""
    rows.write.mode("overwrite").json(path)


def export_array(rows: DataFrame, path: str, order: str) -> None:
    """A small result as one indented UTF-8 JSON array in a local file."""
    found = [json.loads(r[0]) for r in rows.orderBy(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(found, out, ensure_ascii=False, indent=2)

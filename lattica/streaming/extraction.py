"""Extraction over files that keep arriving.

The batch operator's plan is row by row, so it runs unchanged on a stream of
NDJSON records; files are taken once (the checkpoint remembers them) and
results are appended. A bad response stops the stream unless it is set aside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.extraction import Client, extract
from lattica.plans.model import RECORDS


def extract_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, client: Callable[[], Client], mode: str = "abort", files_per_batch: int = 100) -> StreamingQuery:
    """Starts a query that takes what has arrived and ends (trigger
    ``availableNow``); started again it goes on from there."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in RECORDS.fields])
    lines = spark.readStream.schema(raw).option("maxFilesPerTrigger", files_per_batch).json(source)
    records = lines.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDS.fields])
    out = extract(records, client, mode=mode)
    return out.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

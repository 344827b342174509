"""Responses of a model, kept: a prompt is sent once, whatever happens after.

A store is a folder of Parquet files (key, response), the key being a hash of the
prompt. Prompts that it lacks are sent by tasks that write what they got as they
go: every few seconds, and when they fail. A task that is tried again finds the
files of its earlier attempts, and a job that is started again finds those of all
tasks; three parts of one result, or a second run with more records, send only
what is new. A file appears under its name when it is whole. What a task lost
without a word had got since its last file (``EVERY`` seconds) is sent again, and
so is what two attempts of one task work on at once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.catalog import exists
from lattica.sources.ranges import filesystem

STORED = "key string, response string"
#: Seconds and responses after which a task writes a file.
EVERY, MOST = 10.0, 2_000


def key(prompt: Column) -> Column:
    return F.sha2(F.coalesce(prompt, F.lit("\0null")), 256)


def stored(df: DataFrame, store: str) -> DataFrame:
    """(key, response) of a store; empty if there is none yet."""
    spark = df.sparkSession
    if not exists(spark, store):
        return spark.createDataFrame([], STORED)
    found = spark.read.schema(STORED).option("recursiveFileLookup", True).parquet(store)
    return found.groupBy("key").agg(F.first("response").alias("response"))


def _known(folder: str) -> set[str]:
    fs, inner = filesystem(folder)
    files = [f.path for f in fs.get_file_info(FileSelector(inner, allow_not_found=True)) if f.base_name.endswith(".parquet") and f.base_name[0] != "."]
    return {k for f in files for k in pq.read_table(f, filesystem=fs, columns=["key"]).column(0).to_pylist()}


def _keep(folder: str, rows: list[tuple[str, str]]) -> None:
    if not rows:
        return
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    name = f"{uuid.uuid4().hex}.parquet"
    keys, responses = zip(*rows)
    pq.write_table(pa.table({"key": pa.array(keys, pa.string()), "response": pa.array(responses, pa.string())}), f"{inner}/.{name}", filesystem=fs)
    fs.move(f"{inner}/.{name}", f"{inner}/{name}")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """The (key, prompt) of batches, one at a time: as Python texts a whole batch
    takes several times its bytes."""
    for batch in batches:
        for k, prompt in zip(batch.column(0), batch.column(1)):
            yield k.as_py(), prompt.as_py()


def send(asked: Iterator[tuple[str, str]], ask: Callable[[str], str], folder: str, every: float = EVERY) -> Iterator[int]:
    """Sends the prompts of (key, prompt) that the folder lacks, and yields how
    many each file has."""
    known, held, since = _known(folder), [], time.monotonic()
    try:
        for k, prompt in asked:
            if k in known:
                continue
            held.append((k, ask(prompt)))
            if len(held) >= MOST or time.monotonic() - since >= every:
                full, held, since = held, [], time.monotonic()
                _keep(folder, full)
                yield len(full)
    finally:
        _keep(folder, held)
    if held:
        yield len(held)


def once(prompts: DataFrame, client: Callable, store: str, text: Callable[[object], str]) -> DataFrame:
    """(key, response) for the prompts (_key, _prompt), of which those that the
    store lacks are sent now."""
    run_folder = f"{store}/run-{uuid.uuid4().hex}"
    lacking = prompts.select("_key", "_prompt").dropDuplicates(["_key"]).join(stored(prompts, store).select(F.col("key").alias("_key")), "_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []

        def ask(prompt: str) -> str:
            made[:] = made or [client()]
            return text(made[0].invoke(prompt))

        for n in send(each(batches), ask, f"{run_folder}/part-{TaskContext.get().partitionId()}"):
            yield pa.RecordBatch.from_pydict({"n": [n]})

    lacking.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return stored(prompts, store)

"""Two-pass external shuffle into shards.

Pass one scatters every record by seeded hashes: a rendezvous hash of its key
picks the shard, a second hash one of the shard's buckets, which are sized to
fit in memory. Pass two reads a bucket, puts it in canonical order, applies a
Fisher-Yates shuffle seeded by the bucket and writes it. A uniform scatter
followed by uniform shuffles of the buckets is a uniform shuffle of a shard.

The shard depends on the key and the number of shards alone (law ``key``): the
highest of one hash per shard wins, so one more shard only takes rows that it
wins itself. Results depend on the seed and the rows, not on the partitioning
or on retries: rows that the canonical order (key, then a hash of all columns)
leaves equal are alike in every column. Only such rows, wholly alike, share a
bucket whatever their number.

Defined results: null keys share one shard; a null text has size 8 and checksum
0; repeated rows all stay; an empty table writes no bucket; columns of any name
are kept (the operator's own get a suffix if theirs are taken).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.llm.common import fresh, shuffle_partitions

LAW = "key"


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The rendezvous choice of a key among ``shards`` shards."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed), j, key).alias("h"), j.alias("j")))
    return F.array_max(draws)["j"]


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def shuffle_into(
    docs: DataFrame, root: str, shards: int = 24, seed: int = 17, bucket_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text", task_bytes: int = 1 << 30
) -> tuple[DataFrame, tuple[str, str, str]]:
    """Write all rows, shuffled, as Parquet below ``root`` (a shared folder).
    Returns the table read back and the names of its added columns: shard,
    bucket and the position inside the bucket."""
    spark = docs.sparkSession
    names = tuple(fresh(docs.columns, n) for n in ("shard", "bucket", "place"))
    placed = docs.withColumn(names[0], shard_of(F.col(key), shards, seed))
    # One row a shard: the bytes of the largest decide the buckets of each.
    largest = placed.groupBy(names[0]).agg(F.sum(record_size(F.col(text))).alias("b")).agg(F.max("b")).first()[0] or 0
    per_shard = max(4, -(-int(largest) // bucket_bytes))
    whole = F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text), F.to_json(F.struct(*[c for c in docs.columns if c not in (key, text)])))
    sub = F.pmod(whole, F.lit(per_shard))
    bucket = (F.col(names[0]) * F.lit(per_shard) + sub).cast("long")
    tasks = min(shards * per_shard, max(4 * shuffle_partitions(spark), shards * int(largest) // task_bytes))
    scattered = placed.withColumn(names[1], bucket).repartitionById(tasks, F.pmod(F.col(names[1]), F.lit(tasks)).cast("int"))
    ordered = scattered.sortWithinPartitions(names[1], F.col(key), whole)
    schema = T.StructType([*ordered.schema.fields, T.StructField(names[2], T.LongType())])
    at = ordered.columns.index(names[1])

    def deal(held: list[pa.RecordBatch], bucket_id: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        order = np.random.Generator(np.random.PCG64([seed, bucket_id])).permutation(table.num_rows)  # Fisher-Yates
        for start in range(0, table.num_rows, 2048):
            rows = table.take(pa.array(order[start : start + 2048]))
            place = pa.array(np.arange(start, start + rows.num_rows))
            yield from rows.append_column(names[2], place).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ids = batch.column(at).to_numpy()
            if not len(ids):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if current is not None and ids[lo] != current:
                    yield from deal(held, current)
                    held = []
                current = int(ids[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from deal(held, current)

    ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(root)
    return spark.read.schema(schema).parquet(root), names


def digest(written: DataFrame, names: tuple[str, str, str], shards: int = 24, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) from the files."""
    shard, bucket, place = names
    rows = written.select(
        F.col(key).alias("doc_id"),
        record_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.col(shard).alias("shard"),
        F.col(bucket).alias("bucket"),
        F.col(place).alias("place"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        written.select(F.col(shard).alias("shard"), F.col(bucket).alias("bucket")).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    return rows.join(starts, "bucket").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("place")).alias("slot"),
        shard_of(F.col("doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
    )

"""What the training-data operators share: scratch tables in the cluster's
shared folder, word splitting, Arrow batch helpers and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; the complement is a word character.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; one of our own
    only in a local session that names none. A cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="lattica-shared-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Deletes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A uniquely named folder below the shared folder, removed at exit.

    Tables are written once and reread, so a lost executor costs a reread of
    files that everyone can see, not a recomputation of the lineage.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Writes the table and reads it back. What reads it later needs no
        shuffle file of its plan, so Spark deletes those with the execution."""
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            self.drop(name)

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session may already have ended
            if name is not None:
                raise


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the Arrow batches of the session by bytes: rows are counted by the
    thousand there, and a thousand long texts would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """At the end of a task, hand freed memory back to the system: workers live
    on from stage to stage and would hold the most that any of them needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with a suffix if columns of that name are there already."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; 0 for null, empty and blank texts. Splitting at white
    space costs half of what extracting the words does."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def code_points(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A reproducible double in (0, 1) from the first 13 hex digits of an md5."""
    parts = [F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]]
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rows_of(batches: Iterator[pa.RecordBatch], limit_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds much more than ``limit_bytes``;
    a single row may be larger. Rows are never dropped."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= limit_bytes:
            if batch.num_rows:
                yield batch
            continue
        step = max(1, batch.num_rows * limit_bytes // batch.nbytes)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def joined(batches: Iterator[pa.RecordBatch], target_bytes: int, target_rows: int = 1 << 20) -> Iterator[pa.Table]:
    """Gather batches into tables of about ``target_bytes``."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        rows += batch.num_rows
        if size >= target_bytes or rows >= target_rows:
            yield pa.Table.from_batches(held)
            held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


#: A node of more edges than this is a hub. There are at most 2 * edges / HUB.
HUB = 1_000_000


def _with_least(rows: DataFrame, low: DataFrame, hubs: bool) -> DataFrame:
    """Rows (u, v) with m of (w, m, n) where u = w. The rows of hubs, whose
    number is bounded by the edges, meet them by a broadcast, so that a hub's
    edges stay where they are instead of going to one task."""
    if not hubs:
        return rows.join(low, F.col("u") == F.col("w"))
    few, many = F.broadcast(low.where(F.col("n") > HUB)), low.where(F.col("n") <= HUB)
    rest = rows.join(few, F.col("u") == F.col("w"), "left_anti").join(many, F.col("u") == F.col("w"))
    return rows.join(few, F.col("u") == F.col("w")).unionByName(rest)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list.

    Alternates large-star and small-star steps (O(log^2 n) rounds), each two
    aggregations with map-side combine and a join that does not gather hubs.
    Returns (node, component): every node of an edge with the smallest node
    that it reaches. Nulls take no part.
    """
    spark = edges.sparkSession

    label, written = uuid.uuid4().hex[:6], []

    def settle(df: DataFrame, about: int | None = None) -> tuple[DataFrame, tuple]:
        if about is not None:  # no more files than the edges need
            df = df.coalesce(max(1, min(shuffle_partitions(spark), about // 50_000)))
        written.append(f"cc-{label}-{len(written)}")
        out = scratch.table(df, written[-1])
        got = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if len(written) > 2:
            scratch.release(written[-3])
        return out, (got[0], got[1])

    def least(rows: DataFrame, m: Column) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), m.alias("m"), "n")

    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e, before = settle(e)
    for _ in range(200):
        if not before[0]:
            break
        hubs = before[0] > HUB
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both.where(F.col("v") > F.col("u")), least(both, F.least("u", "m")), hubs)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, least(large, F.col("m")), hubs)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e, now = settle(small, 2 * before[0])
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))


def groups(batches: Iterator[pa.RecordBatch], by: int = 0) -> Iterator[tuple[int, pa.Table]]:
    """The runs of equal values of a sorted integer column, whole, one after
    the other; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(by).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = int(ids[lo])
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


class Forest:
    """Union-find over hashable items; ``join`` tells whether it linked anew."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x, y) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

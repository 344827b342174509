"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one from the start. In each pass every distinct vector gets
a key of 64 concatenated random hashes (signs of random projections), vectors
are sorted by it, and each is compared with its ``window`` successors; near
vectors agree on a long prefix of the key in some pass. Verified pairs of all
passes are united into components. Rows that agree on the first ``bits`` of a
key are all compared: a run no longer than the window by the window, a longer
one in blocks, where the pairs that the windows have not joined yet are
compared exactly. So a pair is missed only if it agrees on ``bits`` in no pass,
and the number of passes grows with the rows to hold ``RECALL`` for a pair at
the threshold whatever lies around it; tables of all sizes go this one way. The
links of each vector are then counted exactly against
all vectors of its component, in blocks of about ``block`` by ``block``, so a
large group is spread over many tasks and no list of its pairs is ever made.

Through the passes go 8-bit forms of the vectors with the length of what
rounding took away, which bounds the error of their cosine. A pair that the
bound leaves open is compared in full once, unless its ends are in one component
by then.

Cosines are in double precision; one within 1e-9 of the threshold is summed
without rounding errors, so that every step decides alike. Defined results: vectors that are null, zero
or hold null or non-finite components, and rows without an id, link with
nothing; vectors of unequal lengths compare as if the shorter ended in zeros;
repeated rows link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Forest, Scratch, components, groups, shuffle_partitions

THRESHOLD = 0.9
PASSES = 20  # at least
RECALL = 0.999
WINDOW = 48
BLOCK = 1024


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision, padded with zeros to the longest."""
    rows = [np.frombuffer(v.as_py(), "<f8") for c in vectors.chunks for v in c]
    out = np.zeros((len(rows), max(map(len, rows), default=1)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max()  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum())


def plan(rows: int, threshold: float, passes: int, window: int, block: int, recall: float = RECALL) -> tuple[int, int]:
    """As ``prefixes``, for callers that want a table of up to ``passes`` blocks
    as one run, which is exact; ``near_duplicates`` does not choose by size."""
    return (0, passes) if rows <= passes * block else prefixes(rows, threshold, passes, window, recall)


def prefixes(rows: int, threshold: float, passes: int, window: int, recall: float = RECALL) -> tuple[int, int]:
    """(bits, passes): prefixes that leave about a window of scattered rows a
    run, and the passes in which a pair at the threshold agrees on one with
    probability ``recall``."""
    bits = min(62, max(1, math.ceil(math.log2(max(1, rows) / window))))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, passes if agree == 1 else max(passes, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def keyed(distinct: DataFrame, passes: int, seed: int) -> DataFrame:
    """(rep, vec, small, codes) for each distinct vector, a code a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.empty((passes, 0, 64))
        rngs = [np.random.default_rng([seed, p]) for p in range(passes)]
        weights = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))
        for batch in batches:
            units = [_unit(np.asarray(v.as_py(), float)) for v in batch.column(1)]
            if not units:
                continue
            widest = max(map(len, units))
            while planes.shape[1] < widest:  # a row a dimension, the same in every task
                planes = np.concatenate([planes, np.stack([r.standard_normal((64, 64)) for r in rngs])], axis=1)
            x = np.zeros((len(units), widest))
            for i, u in enumerate(units):
                x[i, : len(u)] = u
            codes = np.empty((len(units), passes), np.int64)
            for p in range(passes):
                codes[:, p] = ((x @ planes[p, :widest] >= 0) * weights).sum(axis=1, dtype=np.uint64).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * passes), pa.array(codes.ravel()))
            whole, small = pa.array([u.astype("<f8").tobytes() for u in units], pa.binary()), pa.array([_small(u) for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), whole, small, lists], ["rep", "vec", "small", "codes"])

    return distinct.select("rep", "embedding").mapInArrow(run, "rep long, vec binary, small binary, codes array<long>")


def _small(unit: np.ndarray) -> bytes:
    """A unit vector in 8-bit steps: the step, the length of the rest, the steps."""
    step = np.abs(unit).max() / 127
    steps = np.rint(unit / step).astype(np.int8)
    rest = np.sqrt(((unit - step * steps) ** 2).sum())
    return np.array([step, rest], "<f8").tobytes() + steps.tobytes()


def _smalls(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors, padded with zeros, and the lengths of their rests."""
    raw = [v.as_py() for c in column.chunks for v in c]
    heads = np.array([np.frombuffer(v[:16], "<f8") for v in raw]).reshape(-1, 2)
    out = np.zeros((len(raw), max((len(v) - 16 for v in raw), default=1)))
    for i, v in enumerate(raw):
        out[i, : len(v) - 16] = np.frombuffer(v[16:], np.int8)
    return out * heads[:, :1], heads[:, 1]


def _error(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most by which a cosine of rounded vectors can be off."""
    return a + b + a * b + 1e-12


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and of y are linked."""
    cosine = x @ y.T
    near = cosine >= threshold
    for i, j in np.argwhere(np.abs(cosine - threshold) < 1e-9).tolist():
        near[i, j] = math.fsum((x[i] * y[j]).tolist()) >= threshold
    return near


LINK, OPEN = 0, 3  # beside the sides of a partition, 1 and 2


def windows(rows: DataFrame, window: int, threshold: float) -> DataFrame:
    """Rows in key order to (a, b, part, side, pass, small): links of each
    partition as a spanning forest, pairs left open whose ends that forest does
    not join, and the rows at the partition's two edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        forest = Forest()
        names = ["a", "b", "part", "side", "pass", "small"]
        kept: pa.Table | None = None
        head: pa.Table | None = None

        def edge(table: pa.Table, side: int) -> pa.RecordBatch:
            n = table.num_rows
            columns = [table["rep"], pa.nulls(n, pa.int64()), pa.array(np.full(n, part)), pa.array(np.full(n, side), pa.int32()), table["pass"], table["small"]]
            return pa.table(columns, names=names).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            if head is None or head.num_rows < window:
                head = fresh.slice(0, window) if head is None else pa.concat_tables([head, fresh.slice(0, window - head.num_rows)])
            old = 0 if kept is None else kept.num_rows
            table = fresh if kept is None else pa.concat_tables([kept, fresh])
            a, b, sides = _window_pairs(table, old, window, threshold, forest)
            if len(a):
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(n, part)), pa.array(sides, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            kept = table.slice(max(0, table.num_rows - window))
        if kept is not None:
            yield edge(head, 1)
            yield edge(kept, 2)

    return rows.mapInArrow(run, "a long, b long, part long, side int, pass int, small binary")


def _window_pairs(table: pa.Table, old: int, window: int, threshold: float, forest: Forest) -> tuple[list[int], list[int], list[int]]:
    """New links and open pairs among rows at most ``window`` apart; the first
    ``old`` rows were already compared with each other."""
    (x, rest), rep, turn = _smalls(table["small"]), table["rep"].to_numpy(), table["pass"].to_numpy()
    a, b, sides, doubt = [], [], [], []
    for s in range(1, min(window, len(x) - 1) + 1):
        lo = max(0, old - s)
        cosine, error = np.einsum("ij,ij->i", x[lo:-s], x[lo + s :]), _error(rest[lo:-s], rest[lo + s :])
        same = turn[lo:-s] == turn[lo + s :]
        for i in (np.flatnonzero((cosine - error >= threshold) & same) + lo).tolist():
            u, v = int(rep[i]), int(rep[i + s])
            if u != v and forest.join(u, v):
                a.append(u)
                b.append(v)
                sides.append(LINK)
        doubt += [(i, i + s) for i in (np.flatnonzero((np.abs(cosine - threshold) < error) & same) + lo).tolist()]
    for i, j in doubt:
        u, v = int(rep[i]), int(rep[j])
        if forest.find(u) != forest.find(v):
            a.append(min(u, v))
            b.append(max(u, v))
            sides.append(OPEN)
    return a, b, sides


def settled(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs (a, b), by their whole vectors."""
    vec = lambda c: units.select(F.col("rep").alias(f"_{c}"), F.col("vec").alias(f"vec_{c}"))
    held = pairs.join(vec("a"), F.col("a") == F.col("_a")).join(vec("b"), F.col("b") == F.col("_b")).select("a", "b", "vec_a", "vec_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(v.as_py(), "<f8") for v in batch.column(2)), (np.frombuffer(v.as_py(), "<f8") for v in batch.column(3))
            width = lambda x, y: min(len(x), len(y))
            near = [bool(_near(x[None, : width(x, y)], y[None, : width(x, y)], threshold)[0, 0]) for x, y in zip(left, right)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    return held.mapInArrow(run, "a long, b long")


def run_links(units: DataFrame, labels: DataFrame, scratch: Scratch, bits: int, window: int, block: int, threshold: float) -> DataFrame | None:
    """(a, b): labels with a link between them, from the runs of equal prefixes
    that are longer than the window and of more than one label. A run's rows
    outside its commonest label are compared with each other and with the
    rest; None if there is no such run."""
    known = labels.select("node", "component")
    own = units.select("rep", "codes").join(known, F.col("rep") == F.col("node"), "left").select("rep", "codes", F.coalesce("component", "rep").alias("label"))
    if bits:
        keys = own.select("rep", "label", F.posexplode("codes").alias("pass", "code")).withColumn("prefix", F.shiftrightunsigned("code", 64 - bits)).drop("code")
    else:
        keys = own.select("rep", "label", F.lit(0).alias("pass"), F.lit(0).cast("long").alias("prefix"))
    sizes = keys.groupBy("pass", "prefix", "label").agg(F.count("*").alias("n"))
    runs = sizes.groupBy("pass", "prefix").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")).where((F.col("n") > window + 1) & (F.col("n") > F.col("main.n")))
    blocks = lambda n: F.ceil(n / F.lit(float(block))).cast("int")
    runs = runs.select(F.col("pass").alias("rp"), F.col("prefix").alias("rx"), F.col("main.label").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("apart"), blocks(F.col("main.n")).alias("same"))
    runs = scratch.table(runs, "runs")
    if runs.isEmpty():
        return None
    rows = keys.join(runs, (F.col("pass") == F.col("rp")) & (F.col("prefix") == F.col("rx"))).join(units.select("rep", "vec"), "rep")
    out, h = F.col("label") != F.col("main"), F.xxhash64("rep")
    rows = rows.withColumn("mine", F.when(out, F.pmod(h, F.col("apart"))).otherwise(F.col("apart") + F.pmod(h, F.col("same"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("apart") - 1 + F.when(out, F.col("same")).otherwise(0))
    grid = F.transform(others, lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    cells = rows.select("pass", "prefix", "label", "vec", "mine", F.explode(grid).alias("g")).select(
        F.xxhash64("pass", "prefix", "g.i", "g.j").alias("cell"), "pass", "prefix", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "mine", "label", "vec"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groups(batches):
            table = cell.to_pandas()
            for (_, _, i, j), part in table.groupby(["pass", "prefix", "i", "j"], sort=False):
                x, label = _matrix(pa.chunked_array([pa.array(part["vec"].tolist(), pa.binary())])), part["label"].to_numpy()
                first = (part["mine"] == i).to_numpy()
                second = first if i == j else ~first
                left, right = label[first], label[second]
                u, v = np.nonzero(_near(x[first], x[second], threshold) & (left[:, None] != right[None, :]))
                if len(u):
                    pairs = np.unique(np.column_stack([left[u], right[v]]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    spread = cells.repartition(shuffle_partitions(units.sparkSession), "cell").sortWithinPartitions("cell")
    return scratch.table(spread.mapInArrow(run, "a long, b long").distinct(), "run-links")


def link_counts(members: DataFrame, block: int, threshold: float) -> DataFrame:
    """(rep, links) from (component, rep, n, vec): the rows within the
    threshold in the component, each distinct vector weighing its n copies."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks")).withColumnRenamed("component", "c")
    placed = members.join(sizes, F.col("component") == F.col("c")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    cells = placed.select("component", "rep", "n", "vec", "mine", F.explode(grid).alias("g")).select(
        F.xxhash64("component", "g.i", "g.j").alias("cell"), "component", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "mine", "rep", "n", "vec"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groups(batches):
            table = cell.to_pandas()
            for (_, i, j), part in table.groupby(["component", "i", "j"], sort=False):
                x = _matrix(pa.chunked_array([pa.array(part["vec"].tolist(), pa.binary())]))
                first = (part["mine"] == i).to_numpy()
                n, rep = part["n"].to_numpy(), part["rep"].to_numpy()
                left, right = (x, x) if i == j else (x[first], x[~first])
                near = _near(left, right, threshold)
                if i == j:
                    np.fill_diagonal(near, False)
                    reps, links = rep, near @ n + n - 1
                else:
                    reps = np.concatenate([rep[first], rep[~first]])
                    links = np.concatenate([near @ n[~first], near.T @ n[first]])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(links.astype(np.int64))], ["rep", "links"])

    spread = cells.repartition(shuffle_partitions(members.sparkSession), "cell").sortWithinPartitions("cell")
    return spread.mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, seed: int = 5
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    plain = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(embedding).alias("embedding"), plain.alias("plain"))
    rows = rows.withColumn("fine", usable(F.col("plain")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "plain")).withColumn("h2", F.xxhash64(F.lit(2), "plain"))
    distinct = scratch.table(
        rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("plain").alias("embedding")), "distinct"
    )
    count = distinct.count()
    bits, passes = prefixes(count, threshold, passes, window)
    units = scratch.table(keyed(distinct, passes, seed), "units")
    codes = units.select(F.posexplode("codes").alias("pass", "code"), "rep", "small")
    parts = shuffle_partitions(spark)
    ranges = max(1, min(parts, count * passes // (4 * window)))  # a window crosses one seam only
    ordered = codes.repartitionByRange(ranges, "pass", "code", "rep").sortWithinPartitions("pass", "code", "rep")
    found = scratch.table(windows(ordered, window, threshold), "found")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groups(batches):
            tail, front = cell.filter(pa.compute.equal(cell["side"], 2)), cell.filter(pa.compute.equal(cell["side"], 1))
            if not tail.num_rows or not front.num_rows:
                continue
            (x, rest_x), (y, rest_y) = _smalls(tail["small"]), _smalls(front["small"])
            width = max(x.shape[1], y.shape[1])
            x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
            cosine, error = x @ y.T, _error(rest_x[:, None], rest_y[None, :])
            i, j = np.nonzero((cosine + error >= threshold) & (tail["pass"].to_numpy()[:, None] == front["pass"].to_numpy()[None, :]))
            sides = np.where((cosine - error)[i, j] >= threshold, LINK, OPEN)
            a, b = tail["a"].to_numpy()[i], front["a"].to_numpy()[j]
            apart = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart]), pa.array(np.maximum(a, b)[apart]), pa.array(sides[apart], pa.int32())], ["a", "b", "side"])

    edges_of = found.where("side in (1, 2)").select(F.when(F.col("side") == 2, F.col("part") + 1).otherwise(F.col("part")).alias("seam"), "side", "pass", "a", "small")
    seams = edges_of.repartition(parts, "seam").sortWithinPartitions("seam").mapInArrow(across, "a long, b long, side int")
    pairs = scratch.table(found.where(F.col("side").isin(LINK, OPEN)).select("a", "b", "side").unionByName(seams), "pairs")
    scratch.release("found")
    edges = pairs.where(F.col("side") == LINK).select("a", "b")
    labels = scratch.table(components(edges, scratch), "sure-labels")
    label = lambda c: labels.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"in_{c}"))
    doubt = pairs.where(F.col("side") == OPEN).select("a", "b").distinct()
    doubt = doubt.join(label("a"), F.col("a") == F.col("_a"), "left").join(label("b"), F.col("b") == F.col("_b"), "left")
    doubt = doubt.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")
    proved = scratch.table(settled(doubt, units, threshold), "proved")
    if not proved.isEmpty():
        edges = edges.unionByName(proved)
        labels = scratch.table(components(edges, scratch), "window-labels")
    more = run_links(units, labels, scratch, bits, window, block, threshold)
    if more is not None and not more.isEmpty():
        labels = components(edges.unionByName(more), scratch)
    members = distinct.select("rep", "n").join(labels, F.col("rep") == F.col("node")).drop("node").join(units.select("rep", "vec"), "rep")
    links = link_counts(members, block, threshold).join(labels, F.col("rep") == F.col("node")).select(F.col("rep").alias("r"), "links", "component")
    known = distinct.select("h1", "h2", "rep", "n").join(links, F.col("rep") == F.col("r"), "left")
    known = known.select("h1", "h2", F.coalesce("links", F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    keys = rows.select("vec_id", *[F.when(F.col("fine"), F.col(h)).alias(h) for h in ("h1", "h2")])
    return keys.join(known, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


#: DuckDB SQL for the whole result over the view embeddings (distinct vec_ids),
#: all pairs compared.
ORACLE = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, s.component_id, s.component_id = e.vec_id AS kept
FROM embeddings e JOIN smallest s ON s.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

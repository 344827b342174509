"""Centroid clustering by ball k-means.

Each cluster is a ball: its centroid and a radius that holds all its members.
Another centroid is a neighbour of a ball if it is no farther away than two
radii; no other can be nearer to a member. A member nearer to its centroid than
half the way to the nearest neighbour is in the stable core and stays without a
comparison. The others lie in annuli: in the q-th, a member is compared exactly
with the q nearest neighbours and no more. The first assignment has no balls yet
and compares with all centroids.

Components become whole numbers (scaled and rounded down), so distances, sums
and centroids are exact and the result does not depend on partitions, batches or
order. A round reads the table of members twice: for the sums of its clusters
(added up in the tasks, then by cluster) and for the next assignment, which is
written, so a lost executor costs the reread of a file. The radius is the
largest distance of the last assignment, widened by the way that the centroid
has moved since. Only k centroids come to the driver.

Defined results: vectors that are null, of another number of components, or with
a null or non-finite component take no part and have no row; repeated rows are
clustered as they come; rows without an id take part and are the last choice as
first centroids; equal first hashes go by the components. With fewer vectors than k there are as many
clusters as vectors, and none gives no row. Components beyond 64 bits are
computed with whole numbers of any size; a distance or sum above the largest
long shows as that. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, give_back

#: Fixed values of the production run.
CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1

_MOST = 2**63 - 1
_MEMBERS = "vec_id long, v array<double>, cluster int, distance long"


@dataclass
class Balls:
    """Centroids as whole numbers and, for each, its neighbours by distance
    (number, squared distance); none before the first assignment."""

    centroids: list[list[int]]
    neighbours: list[list[tuple[int, int]]] | None = None


def whole(vectors: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, scaled and rounded down."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col(vector).isNotNull() & (F.size(vector) == dims)
    kept = vectors.where(F.when(fine, ~odd).otherwise(F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rounded = np.floor(scale * batch.column(1).flatten().to_numpy()) + 0.0  # no negative zero
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rounded, batch.num_rows)], ["vec_id", "v"])

    return kept.mapInArrow(run, "vec_id long, v array<double>")


def _lists(flat: np.ndarray, rows: int) -> pa.ListArray:
    step = len(flat) // rows if rows else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * step), pa.array(flat))


def first_centroids(members: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the least hashes, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    ranked = members.orderBy(F.sha2(name, 256).asc_nulls_last(), "v").limit(k)
    return [[int(x) for x in r.v] for r in ranked.select("v").collect()]


def _between(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def balls(centroids: list[list[int]], radii: list[float]) -> Balls:
    """The neighbours of each centroid: those within two radii."""
    found = []
    for i, c in enumerate(centroids):
        ways = sorted((_between(c, other), j) for j, other in enumerate(centroids) if j != i)
        found.append([(j, d) for d, j in ways if _root(d) <= 2 * radii[i] * (1 + 1e-9)])
    return Balls(centroids, found)


def _root(squared: int) -> float:
    return math.sqrt(squared) if squared < 1 << 1000 else math.inf


def _exact(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as 64-bit whole numbers if four squared distances
    fit there, else as whole numbers of any size."""
    most = max([float(np.abs(x).max(initial=0)), *[float(abs(a)) for c in centroids for a in c]])
    if 16 * x.shape[1] * most * most < 2.0**62:
        return x.astype(np.int64), np.array(centroids, np.int64).reshape(-1, x.shape[1])
    big = np.array([[int(a) for a in row] for row in x], object).reshape(x.shape)
    return big, np.array(centroids, object).reshape(-1, x.shape[1])


def _to(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = x - centroid
    return (away * away).sum(axis=1)


def nearest(x: np.ndarray, cluster: np.ndarray | None, now: Balls) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``x``; ``cluster`` is where
    the rows were. The smaller number wins a tie."""
    x, centroids = _exact(x, now.centroids)
    if cluster is None:
        own, best = np.zeros(len(x), np.int32), _to(x, centroids[0])
        for j in range(1, len(centroids)):
            away = _to(x, centroids[j])
            nearer = away < best
            own[nearer], best[nearer] = j, away[nearer]
        return own, best
    own, best = cluster.astype(np.int32), np.zeros(len(x), x.dtype)
    for i in range(len(centroids)):
        rows = np.flatnonzero(cluster == i)
        if not len(rows):
            continue
        mine = _to(x[rows], centroids[i])
        best[rows] = mine
        # The annulus of a row: the neighbours at most twice as far as the row.
        ways = np.array([d for _, d in now.neighbours[i]], x.dtype)
        annulus = np.searchsorted(ways, 4 * mine, side="right")
        for q, (j, _) in enumerate(now.neighbours[i]):
            outer = rows[annulus > q]
            if not len(outer):
                break
            away = _to(x[outer], centroids[j])
            nearer = (away < best[outer]) | ((away == best[outer]) & (j < own[outer]))
            own[outer[nearer]], best[outer[nearer]] = j, away[nearer]
    return own, best


def assign(members: DataFrame, now: Balls) -> DataFrame:
    """The members with the cluster and the distance of the nearest centroid."""
    dims, known = len(now.centroids[0]), now.neighbours is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            cluster, distance = nearest(x, batch.column(2).to_numpy() if known else None, now)
            if distance.dtype == object:
                distance = np.array([min(d, _MOST) for d in distance.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])
        give_back()

    return members.mapInArrow(run, _MEMBERS)


def sums(members: DataFrame) -> DataFrame:
    """(cluster, n, total, radius): the members of each cluster, their
    componentwise sum in decimal digits and the largest squared distance. Each
    task adds up its rows, so a cluster gathers a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            x, _ = _exact(x, [])
            cluster, distance = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for c in np.unique(cluster).tolist():
                rows = cluster == c
                n, total, radius = held.get(c, (0, [0] * x.shape[1], 0))
                added = x[rows].sum(axis=0).tolist()
                held[c] = [n + int(rows.sum()), [a + int(b) for a, b in zip(total, added)], max(radius, int(distance[rows].max()))]
        rows = [(c, n, [str(a) for a in total], radius) for c, (n, total, radius) in held.items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64()))], ["cluster", "n", "total", "radius"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = [str(sum(map(int, column))) for column in zip(*rows["total"])]
        return pd.DataFrame({"cluster": rows["cluster"][:1], "n": [rows["n"].sum()], "total": [total], "radius": [rows["radius"].max()]})

    schema = "cluster int, n long, total array<string>, radius long"
    return members.select("v", "cluster", "distance").mapInArrow(run, schema).groupBy("cluster").applyInPandas(add, schema)


def moved(now: Balls, by_cluster: list) -> Balls:
    """The centroids after a round, with the balls around them. An empty
    cluster keeps its centroid and has no member to compare."""
    centroids, radii = list(now.centroids), [0.0] * len(now.centroids)
    for r in by_cluster:
        centroids[r.cluster] = [int(a) // r.n for a in r.total]
        shift = _root(_between(centroids[r.cluster], now.centroids[r.cluster]))
        radii[r.cluster] = (_root(r.radius) if r.radius < _MOST else math.inf) + shift
    return balls(centroids, radii)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ball-kmeans")
    members = scratch.table(whole(vectors, dims, scale, key, vector), "whole")
    now = Balls(first_centroids(members, k, seed))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not now.centroids:
        return spark.createDataFrame([], schema)
    members = scratch.table(assign(members, now), "round-0")
    for t in range(1, rounds + 1):
        now = moved(now, sums(members).collect())  # a row a cluster
        members = scratch.table(assign(members, now), f"round-{t}")
        scratch.release("whole" if t == 1 else f"round-{t - 2}")
    # The sums of distances, a row a cluster.
    of = {r.cluster: int(r.total) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    every = min(sum(of.values()), _MOST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.centroids]
    told = [(c, min(total, _MOST), every, digest[c]) for c, total in of.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ORACLE = r"""
WITH RECURSIVE kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), points AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c FROM kept QUALIFY c < 16
), c0 AS MATERIALIZED (
  SELECT c, i, x FROM first JOIN points USING (vec_id)
), a0 AS MATERIALIZED (ASSIGN c0
), c1 AS MATERIALIZED (MOVE a0 c0
), a1 AS MATERIALIZED (ASSIGN c1
), c2 AS MATERIALIZED (MOVE a1 c1
), a2 AS MATERIALIZED (ASSIGN c2
), c3 AS MATERIALIZED (MOVE a2 c2
), a3 AS MATERIALIZED (ASSIGN c3
), told AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c
)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN told USING (c)
"""
_ASSIGN = (
    "SELECT vec_id, c, d FROM (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM"
    " (SELECT p.vec_id, k.c, sum((p.x - k.x) * (p.x - k.x))::BIGINT AS d FROM points p JOIN {0} k ON p.i = k.i GROUP BY p.vec_id, k.c)) WHERE r = 1"
)
_MOVE = (
    "SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM {1} k LEFT JOIN"
    " (SELECT a.c, p.i, floor(sum(p.x)::DOUBLE / count(*))::BIGINT AS x FROM {0} a JOIN points p USING (vec_id) GROUP BY a.c, p.i) m ON m.c = k.c AND m.i = k.i"
)
for _t in range(4):
    ORACLE = ORACLE.replace(f"(ASSIGN c{_t}", f"({_ASSIGN.format(f'c{_t}')}").replace(f"(MOVE a{_t} c{_t}", f"({_MOVE.format(f'a{_t}', f'c{_t}')}")

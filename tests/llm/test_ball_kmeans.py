import hashlib

import duckdb
import numpy as np
import pytest

from lattica.llm import ball_kmeans as bk
from lattica.llm.common import read


def lloyd(rows, k=16, rounds=3, dims=64):
    """Plain k-means in whole numbers of any size: all distances, every round."""
    fine = lambda v: v is not None and len(v) == dims and None not in v and np.isfinite(v).all()
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if fine(v)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    for t in range(rounds + 1):
        found = [min((away(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if t == rounds:
            break
        for j in range(len(centroids)):
            if own := [v for (_, v), (_, c) in zip(kept, found) if c == j]:
                centroids[j] = [sum(column) // len(own) for column in zip(*own)]
    top = 2**63 - 1
    inside = [min(sum(d for d, c in found if c == j), top) for j in range(len(centroids))]
    every = min(sum(min(d, top) for d, _ in found), top)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, top), inside[c], every, digest[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


def test_whole_table_against_all_distances_and_sql(spark):
    table = read(spark, "/root/testdata/sf0.01", "embeddings")
    got = sorted(map(tuple, bk.cluster(table).collect()), key=str)
    assert got == lloyd([(r.vec_id, r.embedding) for r in table.collect()]) and len(got) == 500
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(con.execute(bk.ORACLE).fetchall(), key=str) == got


@pytest.mark.parametrize("cells", [2, 40])
def test_blobs_ties_and_moves(spark, cells):
    """Few and many blobs, equal rows and coarse values with many ties."""
    rng = np.random.default_rng(cells)
    centers = rng.integers(-3, 4, (cells, 6))
    rows = [(i, (centers[i % cells] + rng.integers(-1, 2, 6) / 2).tolist()) for i in range(600)]
    rows += [(1000 + i, centers[0].astype(float).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    for k, rounds in ((16, 3), (5, 6), (1, 2)):
        got = sorted(map(tuple, bk.cluster(table, k=k, rounds=rounds, dims=6).collect()), key=str)
        assert got == lloyd(rows, k, rounds, 6)


def test_balls_leave_out_only_what_cannot_win(spark):
    """Most members are stable or meet few neighbours, and none is misplaced."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (12, 8))
    x = (centers[rng.integers(0, 12, 4000)] + rng.normal(0, 90, (4000, 8))).round()
    centroids = [[int(a) for a in c] for c in centers + 40]
    own, best = bk.nearest(x, None, bk.Balls(centroids))
    radii = [float(np.sqrt(best[own == j].max(initial=0))) for j in range(12)]
    moved = [[a + 15 for a in c] for c in centroids]
    now = bk.balls(moved, [r + np.sqrt(8 * 15**2) for r in radii])
    again, away = bk.nearest(x, own, now)
    want, wanted = bk.nearest(x, None, bk.Balls(moved))
    assert (again == want).all() and (away == wanted).all()
    assert sum(map(len, now.neighbours)) < 12 * 11 / 4


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [-0.0, -0.001]), (7, [2.5, 3.5]), (7, [2.5, 3.5]), (None, [1.0, 1.0]), (8, [1e30, -1e300]), (9, [3e300, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int")
    got = sorted(map(tuple, bk.cluster(table, k=3, rounds=2, dims=2).collect()), key=str)
    assert got == lloyd(rows, 3, 2, 2) and len(got) == 6 and max(r[2] for r in got) <= 2**63 - 1
    empty = bk.cluster(table.where("false"), dims=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

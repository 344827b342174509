import numpy as np
from pyspark.sql import functions as F

from lattica.llm import embedding_dedup as ed
from lattica.llm.common import read


def brute(ids, vectors, threshold=0.9):
    fine = [v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) for v in vectors]
    width = max([len(v) for v, ok in zip(vectors, fine) if ok], default=1)
    x = np.zeros((len(ids), width))
    for i, v in enumerate(vectors):
        if fine[i]:
            x[i, : len(v)] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = dict(enumerate(ids))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i], *[label[j] for j in np.flatnonzero(near[i])]])
            changed |= low != label[i]
            label[i] = low
    return sorted((ids[i], int(near[i].sum()), label[i], label[i] == ids[i]) for i in range(len(ids)))


def test_whole_table(spark):
    table = read(spark, "/root/testdata/sf0.01", "embeddings")
    rows = table.collect()
    got = sorted(map(tuple, ed.near_duplicates(table).collect()))
    assert got == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_large_groups_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base, other = rng.standard_normal((2, 16))
    vectors = [(base + 0.05 * rng.standard_normal(16)).tolist() for _ in range(300)] + [other.tolist()] * 200 + rng.standard_normal((300, 16)).tolist()
    vectors += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [-0.0, 1.0], [0.0, 1.0], [float("inf"), 1.0], []]
    ids = list(range(1000, 1000 + len(vectors)))
    table = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>").withColumn("rep", F.lit("clash")).repartition(5)
    got = sorted(map(tuple, ed.near_duplicates(table, block=64, window=8).collect()))
    assert got == brute(ids, vectors)
    assert ed.near_duplicates(table.limit(0)).count() == 0


def dense(n, mean, d=64):
    """Distinct vectors with about ``mean`` cosine to each other."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(d)
    apart = rng.standard_normal((n, d)) * np.sqrt((1 - mean) / mean / d)
    return (base / np.linalg.norm(base) + apart).tolist()


def test_dense_group_of_distinct_vectors(spark):
    vectors = dense(6000, 0.82)
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4)
    want = brute(list(range(6000)), vectors)
    assert sum(w[1] for w in want) > 2000
    assert sorted(map(tuple, ed.near_duplicates(table).collect())) == want
    rows = ed.near_duplicates(table, block=128).collect()  # more rows than passes of blocks: by prefixes
    assert sum(r.component_id != w[2] for r, w in zip(sorted(rows), want)) <= 0.002 * sum(w[1] > 0 for w in want)


def test_passes_grow_with_the_rows():
    assert ed.plan(20 * 1024, 0.9, 20, 48, 1024) == (0, 20)
    for rows in (50_000, 10**6, 10**8):
        bits, passes = ed.plan(rows, 0.9, 20, 48, 1024)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes >= ed.RECALL and rows / 2**bits <= 48


def test_more_partitions_than_windows(spark):
    vectors = dense(40, 0.88)
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(map(tuple, ed.near_duplicates(table, passes=1).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(list(range(40)), vectors)
    assert sum(w[1] for w in want) > 0 and got == want


def test_small_tables_go_the_way_of_large_ones(spark, monkeypatch):
    seen, found = [], ed.run_links
    monkeypatch.setattr(ed, "run_links", lambda *a: seen.append(a[3]) or found(*a))
    table = spark.createDataFrame(list(enumerate(dense(200, 0.82))), "vec_id long, embedding array<double>")
    ed.near_duplicates(table)
    assert seen == [ed.prefixes(200, 0.9, 20, 48)[0]] and seen[0] == 3

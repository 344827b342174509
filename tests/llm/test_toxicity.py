import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import toxicity as tx
from lattica.llm.common import read


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    for s in np.unique(score):
        rank[np.flatnonzero(score == s)] = np.searchsorted(score[order], s, "left") + (np.sum(score == s) + 1) / 2
    bad = label == 1
    return (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = tx.fit(docs, labels)
    rows = tx.score(docs, model).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    s, y = np.array([r.score for r in held]), np.array([r.toxic for r in held])
    caught, wrong = (s[y == 1] >= 0.7).mean(), (s[y == 0] >= 0.7).mean()
    print("auc", auc(s, y), "caught", caught, "wrong", wrong, "brier", ((s - y) ** 2).mean())
    assert auc(s, y) > 0.95 and caught > 0.85 and wrong < 0.02


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 12, 80).astype(float)
    y = (rng.random(80) < s / 12).astype(float)
    knots, values = tx.isotonic(s, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    levels = np.unique(s)
    n, m = np.array([(s == v).sum() for v in levels]), np.array([y[s == v].mean() for v in levels])
    best = [max(min(np.average(m[i : j + 1], weights=n[i : j + 1]) for j in range(k, len(m))) for i in range(k + 1)) for k in range(len(m))]
    assert np.interp(levels, knots, values) == pytest.approx(np.array(best))


def test_odd_rows_and_disguise(documents, spark):
    docs = documents([(1, None), (2, ""), (3, "fine words here"), (3, "fine words here"), (None, "you 1d1ot"), (4, "w " * 100_000)]).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs, none)
    assert sorted(r.score for r in tx.score(docs, model).collect()) == [0.05] * 6
    assert tx.score(docs.limit(0), model).count() == 0
    row = dict(zip(tx.FEATURES, tx.Featurizer({}).row("YOU are an IDIOT! an i.d.i.o.t and 1d1ot stuuupid")))
    assert row["undone"] == 3 and row["fixed"] == 1 and row["you_near"] > 0 and row["shouted"] > 0 and row["exclaims"] > 0
    kept = tx.reject(docs, model)
    assert kept.count() == 6 and kept.columns == docs.columns

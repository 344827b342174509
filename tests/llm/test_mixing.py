from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing
from lattica.llm.common import read

SF = "/root/testdata/sf0.01"


def shares(sizes, total):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), total
    while True:
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        open_ -= over


def check(docs, slack=None):
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, targets, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    source = defaultdict(list)
    for r in docs.collect():
        source[r.doc_id].append(r.source)
    for r in rows:
        s = source[r.doc_id].pop()
        sizes[s] += r["size"]
        taken[s] += r.taken
        targets[s] = (r.target, r.source_size)
        longest[s] = max(longest[s], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = shares(sizes, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert targets[s][0] == pytest.approx(want[s]) and targets[s][1] == sizes[s]
        assert abs(taken[s] - want[s]) <= (longest[s] / 2 + 1 if slack is None else slack)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.report(docs.repartition(7)).collect()), key=str)


def test_whole_table(spark):
    check(read(spark, SF, "documents"))


def test_sql(spark):
    got = sorted(map(tuple, mixing.report(read(spark, SF, "documents")).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    assert got == want


def test_skewed_sources_nulls_and_empty(documents):
    rows = [(i, "w " * (1 + i % 7), "hot") for i in range(400)] + [(1000 + i, "a b c", s) for i, s in enumerate([None, "é", "z", "Z", "b", "b"])]
    docs = documents([*rows, (2000, None, None), (2001, "", "b")]).withColumn("target", F.lit("clash"))
    check(docs)
    assert mixing.report(docs.limit(0)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and 400 < mixed.count() < 820
    tied = documents([(1, "x y", "a")] * 10 + [(2, "x", "b")])
    assert mixing.report(tied).count() == 11


def test_word_count(spark):
    from lattica.llm.common import word_count

    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a  b\n", "a b c", "x y z\x1cq \x85", "é \r\n ü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_salted_join_is_the_same(documents):
    docs = documents([(i, "w " * (1 + i % 5), "hot" if i % 3 else None) for i in range(60)])
    sized = mixing.sizes(docs)
    cuts = mixing.plan(sized).withColumnRenamed("source", "s").withColumnRenamed("weight", "w")
    names = {"source": "s", "weight": "w"}
    plain = mixing._beside(sized, cuts, names).select("doc_id", "cut", "odds")
    salted = mixing._beside(sized, cuts, names, most_bytes=0).select("doc_id", "cut", "odds")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect())) and salted.count() == 60


def test_inclusion_odds_are_unequal_inside_a_source(documents, spark):
    """Over many seeds each document is taken about as often as its weight
    says; the heaviest for certain. One source, equal sizes, a rate of 0.4."""
    weights = [0.125, 0.25, 0.5, 1.0] * 30
    docs = documents([(i, "a b c d", "one") for i in range(len(weights))]).withColumn("n_chars", F.element_at(F.array(*map(F.lit, weights)), (F.col("doc_id") + 1).cast("int")))
    sized = mixing.sizes(docs, weight=F.col("n_chars")).cache()
    times = dict.fromkeys(range(len(weights)), 0)
    rounds = 12
    for seed in range(rounds):
        cuts = mixing.plan(sized, seed, share=0.75)
        for r in mixing._taken(sized, cuts, "doc_id", {"source": "source", "weight": "weight"}, "m_", seed).collect():
            times[r.doc_id] += r.m_copies
    level = 0.75 / (sum(weights) / len(weights))
    for w in sorted(set(weights)):
        mean = sum(times[i] for i in times if weights[i] == w) / rounds / 30
        assert mean == pytest.approx(min(2, level * w), abs=0.12)
    ones = [times[i] for i in times if weights[i] == 1.0]
    assert min(ones) >= rounds  # an average of 1.6: one whole copy for certain


def test_names_that_clash(documents):
    docs = documents([(i, "a b", "x") for i in range(20)]).withColumn("_mix_copies", F.lit("mine")).withColumn("_deal", F.lit(1)).withColumn("weight", F.lit(9))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r._mix_copies for r in mixed.collect()} == {"mine"}


def test_small_odds_are_spread_over_buckets(documents, monkeypatch):
    """A share of a thousandth: the ranks of a source lie in many buckets, and
    the cut is that of ordering all of them."""
    docs = documents([(i, "a b c", "one") for i in range(3000)])
    sized = mixing.sizes(docs)
    written = []
    monkeypatch.setattr(mixing, "_beside", lambda rows, *a, real=mixing._beside, **k: (written.append(rows), real(rows, *a, **k))[1])
    cut = mixing.plan(sized, share=0.001).first()
    ranked = next(r for r in written if "rank" in r.columns)
    per = [r["count"] for r in ranked.groupBy("b").count().collect()]
    assert max(per) <= 25 and sum(per) == 3000
    rows, ahead, want = sorted((r["rank"], r["size"]) for r in ranked.select("rank", "size").collect()), 0, None
    for rank, size in rows:
        if ahead + size / 2 <= cut.target:
            want = rank
        ahead += size
    assert want is not None and cut.cut == want

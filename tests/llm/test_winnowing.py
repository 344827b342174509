import hashlib
import random
import re

import duckdb
import pytest

from lattica.llm import winnowing
from lattica.llm.common import read

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return SPLIT.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window=10):
    """Every window of every document against every window of every item."""
    owners = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), window)
        for j in range(len(w) - n + 1) if n else ():
            owners.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    lengths = sorted({len(b) for b in owners})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if ids := owners.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, digest string, at int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    return d, b, sorted(map(tuple, winnowing.report(d, b, **more).collect()), key=str)


def test_whole_table_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    got = sorted(map(tuple, winnowing.report(docs, bench).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sum(r[5] for r in got) > 5
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(con.execute(winnowing.ORACLE).fetchall(), key=str) == got


def test_only_built_in_functions(spark):
    docs, bench = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "benchmark")
    plan = winnowing.report(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    """Few different words: many ties, grams that repeat inside a window, items
    of all lengths, shared passages, copies of items and documents."""
    r = random.Random(seed)
    make = lambda n: " ".join(r.choices("ab" if seed == 0 else "abcdefgh", k=n))
    items = [(i, make(r.choice([1, 3, 9, 10, 11, 14, 30]) if seed else r.choice([10, 12, 25]))) for i in range(12)]
    passage = make(13)
    items += [(20 + i, f"{make(2)} {passage} {make(i)}") for i in range(6)] + [(40 + i, items[3][1].upper()) for i in range(5)]
    docs = [(i, make(r.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{make(5)}, {passage}! {r.choice(items)[1]} {make(3)}") for i in range(20)]
    docs += [(200 + i, docs[45][1]) for i in range(30)]
    _, _, got = run(spark, docs, items)
    assert got == brute(docs, items)


def test_odd_rows(spark):
    ten = "One two three four five six seven eight nine ten"
    items = [(1, ten), (1, "alpha"), (None, "Été à la mer"), (2, None), (3, ""), (4, "... !!"), (5, ten.replace(" ", "\n\n"))]
    docs = [(1, None), (2, ""), (None, "x " + ten), (3, "?!"), (7, "ten ALPHA"), (7, "ten ALPHA"), (7, "other"), (8, "Été à la mer été À la mer"), (9, "one_two three four five six seven eight nine ten"), (10, "one two"), (11, ("z " * 60_000) + ten + " q" * 60_000)]
    d, b, got = run(spark, docs, items)
    assert got == brute(docs, items)
    found = sorted(map(tuple, winnowing.passages(d, b).collect()), key=str)
    assert (11, 60_000, 60_010, 1) in found and found.count((7, 1, 2, 1)) == 2
    none = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[2:] for r in winnowing.report(d, b.where("false")).collect()} == {(0, 0, none, False)}
    assert winnowing.report(d.where("false"), b).collect() == []


def test_another_window(spark):
    docs = [(1, "a b c d e f g h"), (2, "x c d e y"), (3, "c d"), (4, "q")]
    items = [(1, "b c d e"), (2, "c d e f")]
    _, _, got = run(spark, docs, items, window=3, gram=2)
    assert got == brute(docs, items, 3)

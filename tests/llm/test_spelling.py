import random
import re
import zlib
from collections import Counter

import numpy as np

from lattica.llm import spelling
from lattica.llm.common import Scratch, read


def near_by_brute_force(a, b):
    """Exactly one code point put in, left out or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n, pairs, times=10):
    of = {}
    for a, b in pairs:
        of.setdefault(a, set()).add(b)
    form = {}
    for w in n:
        best = min(of.get(w, ()), key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(of.get(w, ())), n[form[w]] if w in form else None) for w in n)


def plain_counts(docs, least=7, seen=2, every=31):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: c for w, c in found.items() if len(w) >= least and c >= seen}


def all_pairs(words):
    return [(a, b) for a in words for b in words if near_by_brute_force(a, b)]


def by_deletion(words):
    """Near words through the words without one code point, for larger tables."""
    shorter = {}
    for w in words:
        for i in range(len(w)):
            shorter.setdefault((w[:i] + w[i + 1 :]), set()).add(w)
    pairs = {(a, b) for g in shorter.values() for a in g for b in g if a < b and near_by_brute_force(a, b)}
    pairs |= {tuple(sorted((w, v))) for w in words for v in shorter.get(w, ())}
    return [p for a, b in pairs for p in ((a, b), (b, a))]


def sorted_rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    n = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted_rows(spelling.variants(docs))
    assert got == plain_forms(n, by_deletion(set(n)))
    assert sum(r[1] is not None for r in got) > 20


def test_small_alphabet_and_split_halves(spark):
    """Many neighbours and runs of one letter, whole and in blocks."""
    r = random.Random(3)
    words = {"".join(r.choices("ab", k=k)) for k in (7, 8, 9) for _ in range(90)} | {"a" * k for k in range(7, 14)} | {"a" * 7 + "é", "éaaaaaaa", "aaaa😀aaa", "b" * 300, "b" * 299, "b" * 150 + "c" + "b" * 149}
    n = {w: r.choice([2, 3, 30, 400, 5000]) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_forms(n, all_pairs(words))
    assert sorted_rows(spelling.forms(table)) == want
    assert sorted_rows(spelling.forms(table, block=60)) == want
    pairs = spelling.near(table, Scratch(spark, "test"), block=90).select("word", "near").collect()
    assert sorted(map(tuple, pairs)) == sorted(all_pairs(words))


def test_chains_end_at_the_last_form(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "zbcdefg": 20}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted_rows(spelling.forms(table))
    assert got == plain_forms(n, all_pairs(n)) and got[0][1:3] == ("abcdefgh", "abcdefghijk")


def test_the_tree_reports_every_point():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 64, 100):
        values = rng.permutation(size)
        a, c = rng.integers(0, size, (2, 50))
        b, d = np.minimum(a + rng.integers(0, size + 1, 50), size), np.minimum(c + rng.integers(0, size + 1, 50), size)
        who, value = spelling.WaveletTree(values).report(a, b, c, d)
        want = sorted((k, int(v)) for k in range(50) for v in values[a[k] : b[k]] if c[k] <= v < d[k])
        assert sorted(zip(who.tolist(), value.tolist())) == want


def test_odd_rows(spark):
    long_run = "xyzw" * 20_000
    docs = [(1, None), (2, ""), (None, "Straßen STRASSEN straßen Straßem straßem"), (3, "hyphen-ated don't ÀÉÎÕÜÝÞ àéîõüýþ ÀÉÎÕÜÝÞ àéîõüýþ"), (4, long_run), (5, long_run + " " + long_run), (6, long_run[1:] + " " + long_run[1:])]
    docs += [(7, "letters letters lettters"), (7, "letters letters lettters"), (8, "1234567 !!!!!!!")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    n = plain_counts(docs)
    assert sorted_rows(spelling.variants(table)) == plain_forms(n, by_deletion({w for w in n if len(w) < 1000}) + [(a, b) for a in n for b in n if len(a) >= 1000 and len(b) >= 1000 and (a[1:] == b or b[1:] == a)])
    assert spelling.variants(table.where("false")).collect() == []

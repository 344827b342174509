import random
import re

from pyspark.sql import functions as F

from lattica.llm import chosen_path as cp
from lattica.llm import rare_prefix
from lattica.llm.common import read


def shingle_set(text, width):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [(k, shingle_set(t, width)) for k, t in rows]
    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (k, s) in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            shared = len(s & sets[j][1])
            if k is not None and sets[j][0] is not None and 100 * shared >= percent * len(s | sets[j][1]):
                up[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k if k is not None else -1, len(s), low.get(find(i), -1)) for i, (k, s) in enumerate(sets))


def got(docs, **more):
    rows = cp.near_duplicates(docs, **more).collect()
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in rows)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in rows)


def test_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 3, 85)
    assert sum(k != c for k, _, c in want) > 20
    assert got(docs, width=3, percent=85) == want


def test_large_near_group_and_chains(documents):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):  # a group far above the limits, pairs around the threshold
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):
        rows.append((1000 + i, " ".join(chain)))
        chain = [*chain[3:], *[f"c{100 + 3 * i + j}" for j in range(3)]]
    rows += [(2000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " common line of text here") for i in range(200)]
    assert got(documents(rows), width=3, percent=85) == brute(rows, 3, 85)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a  B"), (8, "İ x y z"), (9, "w " * 100_000), (10, "w " * 100_001), (None, "a"), (None, "b")]
    docs = documents(rows).withColumn("rep", F.lit(1)).withColumn("h1", F.lit("clash"))
    assert got(docs, width=3, percent=85) == brute(rows, 3, 85)
    assert got(docs.limit(0)) == []
    kept = sorted((r.doc_id or 0, r.text or "") for r in cp.keep_first(docs).collect())
    assert [k for k, _ in kept] == [0, 0, 1, 2, 3, 4, 6, 8, 9] and cp.keep_first(docs).columns == docs.columns


def test_same_text_same_id(documents):
    docs = documents([(5, "one two three four"), (5, "one two three four"), (6, "one two three four"), (7, "other words are here")])
    assert got(docs, width=3, percent=85) == [(5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 2, 7)]
    assert cp.keep_first(docs).count() == 2


def with_labels(spark, sets, labels):
    """Postings of the sets with their labels, through the library's own steps."""
    tokens = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "rep long, token long")
    sizes = spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "rep long, n long")
    return rare_prefix.postings(tokens, sizes, 85).join(spark.createDataFrame(list(labels.items()), "rep long, label long"), "rep")


def test_rare_prefixes_lose_no_pair(spark):
    rng = random.Random(3)
    sets = {}
    for rep in range(260):  # templates in templates, sizes from 1 to 90, pairs around the threshold
        base = list(range(rng.choice([1, 5, 40, 60]))) + [1000 + rng.randrange(3)] * (rep % 3)
        own = [10_000 + rng.randrange(300) for _ in range(rng.randrange(0, 10))]
        sets[rep] = set(base) | set(own) or {rep}
    labels = {rep: rep % 50 if rep % 4 else 7 for rep in sets}
    want = {(a, b) for a in sets for b in sets if a < b and labels[a] != labels[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    rows = with_labels(spark, sets, labels).cache()
    found = [tuple(r) for r in rare_prefix.pairs(rows, 85).collect()]
    assert len(want) > 100 and want <= set(found) and len(found) == len(set(found))
    assert all(a < b and labels[a] != labels[b] for a, b in found)
    near = [tuple(r) for r in rare_prefix.nearest(rows, 85).collect()]
    assert near and set(near) <= set(found) and len(near) <= len(sets)


def test_unlinked_templates_make_no_pairs(spark):
    counts = []
    for n in (100, 400):  # one template of 90, own tokens at Jaccard 0.81, nothing linked
        sets = {i: set(range(90)) | {1000 + 20 * i + j for j in range(10 + i % 2)} for i in range(n)}
        counts.append(rare_prefix.pairs(with_labels(spark, sets, {i: i for i in sets}), 85).count())
    assert counts == [0, 0]


def test_large_nodes_of_several_groups(documents, monkeypatch):
    monkeypatch.setattr(cp, "SMALL", 4)
    monkeypatch.setattr(cp, "CHUNK", 16)
    posted = []
    monkeypatch.setattr(rare_prefix, "pairs", lambda rows, percent, real=rare_prefix.pairs: (posted.append(rows.count()), real(rows, percent))[1])
    rng = random.Random(9)
    base = [f"w{i}" for i in range(110)]
    rows = []
    for i in range(360):  # twelve endings of one template, some documents between two of them
        end = [f"e{i % 12}x{j}" for j in range(14)]
        if i % 30 == 0:
            end[7:] = [f"e{(i + 1) % 12}x{j}" for j in range(7, 14)]
        end[rng.randrange(14)] = f"own{i}"
        rows.append((i, " ".join(base + end)))
    rows += [(500 + i, " ".join(base + [f"o{i}x{j}" for j in range(16)])) for i in range(60)]
    assert got(documents(rows), width=3, percent=85) == brute(rows, 3, 85)
    assert posted and posted[0] > 0

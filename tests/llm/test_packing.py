import itertools
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import packing
from lattica.llm.common import read


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.sort(rng.choice(60, size=9, replace=False))
        c = rng.integers(1, 30, size=9)
        for k in (1, 2, 3, 5, 20):
            got = packing.optimal_bounds(x, c, k)
            best = min(padding(x, c, [*some, x[-1]]) for some in itertools.combinations(x[:-1], min(k, 9) - 1))
            assert padding(x, c, got) == best


def check(docs, **more):
    rows = packing.pack(docs, **more).collect()
    limit, budget = more.get("max_len", packing.MAX_LEN), more.get("token_budget", packing.TOKEN_BUDGET)
    want = Counter()
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        for p in range(max(1, -(-n // limit))):
            want[(r.doc_id, p, p * limit, min(limit, n - p * limit))] += 1
    assert Counter((r.doc_id, r.piece, r.first_word, r.n_tokens) for r in rows) == want
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bound - r.n_tokens >= 0
        batches[(r.bucket, r.batch)].append((r.slot, r.bound))
    full = Counter(b for b, _ in batches)
    for (bucket, batch), slots in batches.items():
        bound = slots[0][1]
        most = max(1, budget // max(1, bound))
        assert sorted(s for s, _ in slots) == list(range(len(slots))) and len(slots) <= most
        assert len(slots) == most or batch == full[bucket] - 1
    histogram = Counter(r.n_tokens for r in rows)
    x, c = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    if len(x):
        assert sum(r.padding for r in rows) == padding(x, c, packing.optimal_bounds(x, c, more.get("buckets", packing.BUCKETS)))


def test_whole_table(spark):
    check(read(spark, "/root/testdata/sf0.01", "documents"))
    check(read(spark, "/root/testdata/sf0.001", "documents"), max_len=100, buckets=3, token_budget=512)


def test_odd_rows(documents):
    docs = documents([(1, None), (2, ""), (2, ""), (None, "a b"), (4, "w " * 30_000), (5, "x")]).withColumn("bucket", F.lit("mine"))
    check(docs)
    check(docs.limit(0))

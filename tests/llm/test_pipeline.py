from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lattica.llm import mixing, toxicity
from lattica.llm.common import read
from tests.llm.test_chosen_path import brute as brute_near
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_packing import check as check_pack
from tests.llm.test_secret_scan import brute as brute_secrets

SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_input(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    stages = dict(cp.STAGES)
    docs = read(spark, SF, "documents")
    columns = docs.columns

    clean = stages["toxicity"](spark, docs, SF).cache()
    labels = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in clean.collect()}
    score = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, read(spark, SF, "labels"))).collect()}
    assert kept == {k for k, p in score.items() if not p}
    assert sum(k in kept for k, t in labels.items() if t == 0) >= 0.98 * sum(t == 0 for t in labels.values())

    single = stages["near_duplicates"](spark, clean, SF).cache()
    want = brute_near([(r.doc_id, r.text) for r in clean.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(k for k, _, c in want if k == c)

    masked = stages["secrets"](spark, single, SF).cache()
    before = {r.doc_id: r for r in single.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert sum(brute_secrets(r.text)[:3]) == 0 and r.n_chars == len(r.text)
        if sum(brute_secrets(before[k].text)[:3]) == 0:
            assert r.text == before[k].text

    check_mix(masked)
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.report(masked).collect() if r["size"]}
    mixed = stages["mixing"](spark, masked, SF).cache()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in taken.items() if n})
    assert all(d.columns == columns for d in (clean, single, masked, mixed))
    check_pack(mixed)


def test_run(spark):
    got = cp.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["doc_id", "piece", "first_word", "n_tokens"] and got.count() > 0


def test_stages_on_odd_rows(spark, documents):
    """Null ids, texts and sources, repeated rows and columns of clashing names
    go through every stage as its docstring says; so does an empty table."""
    sf = "/root/testdata/sf0.001"
    clean = "a plain line about rivers and hills number"
    rows = [(i, f"{clean} {i} " + " ".join(f"w{i}x{j}" for j in range(12)), "ab"[i % 2]) for i in range(20)]
    rows += [(3, rows[3][1], "b"), (None, "no id " + clean, "a"), (None, None, None), (40, None, "a"), (41, "", None), (42, " \n", "b"), (43, rows[5][1], "a"), (44, "password=hunter2hunter2 " + rows[6][1][::-1], None)]
    odd = documents(rows).withColumn("score", F.lit("mine")).withColumn("rep", F.lit(7)).withColumn("_mix_copies", F.lit("x"))
    stages = dict(cp.STAGES)
    ids = lambda df: Counter(r.doc_id for r in df.collect())

    kept = stages["toxicity"](spark, odd, sf).cache()
    assert ids(kept) == ids(odd)
    single = stages["near_duplicates"](spark, odd, sf).cache()
    assert ids(single) == ids(odd) - Counter([3, 43])
    masked = stages["secrets"](spark, odd, sf).cache()
    assert ids(masked) == ids(odd) and not masked.where("text like '%hunter2%'").count()
    mixed = stages["mixing"](spark, odd, sf).cache()
    assert not mixed.where("text is null or trim(text) = ''").count() and set(ids(mixed)) <= set(ids(odd)) - {40, 41, 42}
    assert len({n for k, n in ids(mixed.where("doc_id = 3")).items()}) <= 1 and mixed.where("doc_id = 3").count() % 2 == 0
    assert all(d.columns == odd.columns for d in (kept, single, masked, mixed))
    packed = stages["packing"](spark, odd, sf).cache()
    assert set(ids(packed)) == set(ids(odd))
    for name, stage in cp.STAGES:
        none = stage(spark, odd.limit(0), sf)
        assert none.count() == 0 and (name == "packing" or none.columns == odd.columns)

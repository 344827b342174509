import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from lattica.llm import external_shuffle as es
from lattica.llm.common import Scratch, read


def run(docs, spark, **more):
    root = Scratch(spark, "t8").path("shards")
    written, names = es.shuffle_into(docs, root, **more)
    return written, names, es.digest(written, names).collect()


def test_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    written, names, got = run(docs, spark, bucket_bytes=1 << 14)
    want = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(order, order[1:])) / len(order)
    assert 0.42 < rising < 0.58
    assert written.select(*docs.columns).exceptAll(docs).isEmpty() and written.count() == docs.count()
    again = run(docs.repartition(5), spark, bucket_bytes=1 << 14)[2]
    assert sorted(again) == sorted(got)


def test_nulls_ties_empty_clashes(documents, spark):
    docs = documents([(None, None), (None, "x"), (3, "a"), (3, "a"), (4, "")]).withColumn("shard", F.lit("mine")).withColumn("Bucket", F.lit(1))
    got = run(docs, spark)[2]
    assert len(got) == 5 and sorted(r["size"] for r in got) == [8, 8, 9, 9, 9]
    assert run(docs.limit(0), spark)[2] == []

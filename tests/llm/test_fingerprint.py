import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import fingerprint as fp
from lattica.llm.common import read


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        out[doc_id] = (len(text), text[: len(text) - k] + after[:k])
    return out


def check(docs):
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in fp.edit_report(docs).collect()}
    assert got.keys() == want.keys()
    for k, (n, edited) in want.items():
        assert (got[k].n_chars, got[k].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        assert (got[k].fingerprint == got[k].edited_fingerprint) == (got[k].near_edited == 1)
    return got


def test_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = check(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_text = {}
    for k, r in got.items():
        assert by_text.setdefault(texts[k], r.fingerprint) == r.fingerprint
    assert len(by_text) == len({r.fingerprint for r in got.values()})
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_odd_texts(documents):
    got = check(documents([(1, None), (2, ""), (3, "é" * 10), (4, "a\n\nb\n c. d e"), (9, "x"), (10, "word " * 100_000), (11, " \n\n\n ")]))
    assert got[1].fingerprint == got[2].fingerprint
    check(documents([(5, "only one document here")]))


def test_ties_nulls_and_empty(documents, spark):
    docs = documents([(None, "no id"), (7, "same"), (7, "same"), (7, "other")]).withColumn("next_text", F.lit("clash"))
    assert fp.edit_report(docs).count() == 4
    assert fp.edit_report(docs.limit(0)).count() == 0


def test_changed_branches(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nB\n\nc\nd"), ("a\n\nb", "a")], "x string, y string")
    got = df.select("*", fp.tree(F.col("x")).alias("t"), fp.tree(F.col("y")).alias("u")).select(fp.changed_paragraphs(F.col("t.sections"), F.col("u.sections")).alias("c")).collect()
    assert [[tuple(p) for p in r.c] for r in got] == [[(0, 1)], [(1, 0)]]


PIECE = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", fp.PIECE))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_tree(text):
    """The printed fingerprint and all leaves, straight from the definition."""
    sections, leaves, shown = [], Counter(), []
    for section in (text or "").split("\n\n"):
        paragraphs = []
        for paragraph in section.split("\n"):
            pieces = [md5(m.group()) for m in PIECE.finditer(paragraph)]
            assert "".join(m.group() for m in PIECE.finditer(paragraph)) == paragraph
            leaves.update(p[:8] for p in pieces)
            paragraphs.append((md5("".join(pieces)), "".join(p[:8] for p in pieces)))
        sections.append(md5("".join(d for d, _ in paragraphs)))
        shown.append(sections[-1][:16] + "(" + ",".join(f"{d[:16]}[{p}]" for d, p in paragraphs) + ")")
    return hashlib.sha256("".join(sections).encode()).hexdigest() + ":" + ";".join(shown), leaves


def plain_near(a, b):
    (root_a, x), (root_b, y) = plain_tree(a), plain_tree(b)
    if root_a == root_b:
        return 1.0
    return 2.0 * (x & y).total() / (x.total() + y.total()) if x or y else 0.0


def test_against_a_plain_tree(documents):
    rng = random.Random(4)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(n))
    texts = [han(3000), han(2999), words(400), "same line again\n" * 200, "\n\n".join(words(30) for _ in range(9)), None, "", "x", "𠀀🎉" * 400, "Zq" * 3000, words(5)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fp.edit_report(documents(rows)).collect()}
    order = sorted(rows, reverse=True)
    for at, (k, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[k].fingerprint == plain_tree(text)[0] and got[k].edited_fingerprint == plain_tree(edited)[0]
        assert (got[k].near_edited, got[k].near_next) == (plain_near(text, edited), plain_near(text, after))
    assert all(0.55 < got[k].near_edited < 0.8 for k in (0, 1, 2, 4))  # two thirds are left, in unspaced text as well
    assert got[3].near_edited > 0.55  # repeated lines count as often as they occur


def test_one_id_that_holds_most_rows(documents):
    rows = [(None, f"text {i} without an id") for i in range(300)] + [(i, f"text {i}") for i in range(30)]
    got = fp.edit_report(documents(rows)).collect()
    assert len(got) == 330
    following = Counter(r.edited_sha256 for r in got)
    ordered = fp.with_next(documents(rows).select("doc_id", "text"), "doc_id", "text", ["text"]).collect()
    assert Counter(r.next_text for r in ordered) == Counter(t for _, t in rows)  # a ring: each text follows once
    assert following.total() == 330


@pytest.mark.parametrize(("partitions", "ids", "copies"), [(200, 600, 1), (200, 500, 20), (2000, 1, 1), (2000, 300, 2)])
def test_more_partitions_than_rows(spark, documents, partitions, ids, copies):
    """Spark's default partitions and many, over few rows and repeated ids."""
    rows = [(i, f"text {i} {k} " + "x" * (i % 7)) for i in range(ids) for k in range(copies)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = fp.edit_report(documents(rows)).select("doc_id", "edited_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    if copies == 1:
        text, after = dict(rows), {i: ids - 1 if i == 0 else i - 1 for i in range(ids)}
        for r in got:
            mine, third = text[r.doc_id], len(text[r.doc_id]) // 3
            edited = mine[: len(mine) - third] + text[after[r.doc_id]][:third]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import token_files as tf
from lattica.llm.common import Scratch, read

tokenizers = pytest.importorskip("tokenizers")
tables = pytest.importorskip("public_tokenizers")
FILE = tables.path("byte_bpe_50k.json")


def expected(rows):
    library = tokenizers.Tokenizer.from_file(FILE)
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def run(docs, spark):
    root = Scratch(spark, "t3").path("tokens")
    return [tuple(r) for r in tf.documents(spark, root, tf.write(docs, root, FILE)).collect()]


def test_whole_table_round_trip(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    want = expected([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert sorted(run(docs, spark)) == want


def test_odd_texts(documents, spark):
    odd = [
        (0, None), (1, ""), (2, " "), (3, "  a  b\n\n c \t"), (4, "x\n y\r\nz"), (5, "it's  I'll 'tis"), (6, "a b 　 c\x1cd \x85e"),
        (7, "né 漢字 🎉 12 3.4%%% a&&&"), (8, "word " * 60_000), (9, "<|endoftext|> x<|endoftext|>\ny <|endoftext|>"), (10, "\n"), (11, "\ta b"), (12, "a \n"),
    ]
    assert sorted(run(documents(odd), spark)) == expected(odd)


def test_ties_nulls_and_empty(documents, spark):
    got = run(documents([(None, "first"), (5, "b"), (5, "a"), (5, "a")]), spark)
    assert sorted(r[1] for r in got)[0] == 0 and len(got) == 4
    assert [r for r in got if r[0] is None][0][1] == 0
    assert run(documents([(1, "a")]).limit(0), spark) == []


def test_small_memo_long_units_and_clashes(documents, spark, monkeypatch):
    monkeypatch.setattr(tf, "_encoder", lambda file: tf.Encoder(file, most=3))
    rows = [(i, f"w{i} same words again {'漢' * (300 + i)}") for i in range(40)]
    docs = documents(rows).withColumn("h", F.lit("clash")).withColumn("name", F.lit(1))
    assert sorted(run(docs, spark)) == expected(rows)
    encoder = tf.Encoder(FILE, most_bytes=1000)
    encoder.encode(["漢" * 500, "few words"], 2)
    assert "漢" * 500 not in encoder.known and 0 < encoder.bytes <= 1000 and len(encoder.known) == 2
    encoder.encode([f"word{i}" for i in range(200)], 2)
    assert 0 < encoder.bytes <= 1000 and len(encoder.known) == 2


def test_files_of_other_attempts_go(documents, spark):
    root = Scratch(spark, "t3").path("tokens")
    docs = documents([(i, f"text {i}") for i in range(9)])
    tf.write(docs, root, FILE)
    again = tf.write(docs, root, FILE)  # as a rerun into the same folder
    names = {r.name for r in again.collect()}
    where, base = tf._open(root)
    found = {f.base_name.rpartition(".")[0] for f in where.get_file_info(tf.fs.FileSelector(base)) if f.base_name.endswith(("bin", "off", "doc"))}
    assert found == names
    assert [tuple(r) for r in tf.documents(spark, root).orderBy("doc_id").collect()] == expected([(i, f"text {i}") for i in range(9)])


def test_reads_without_a_memory_map(tmp_path):
    (tmp_path / "x").write_bytes(np.arange(100, dtype="<u4").tobytes())
    far = tf.fs.SubTreeFileSystem(str(tmp_path), tf.fs.LocalFileSystem())
    assert tf._File(far, "x", "<u4")[10:13].tolist() == tf._File(tf.fs.LocalFileSystem(), str(tmp_path / "x"), "<u4")[10:13].tolist() == [10, 11, 12]


def test_slices_of_a_shard(documents, spark):
    rows = [(i, f"text number {i}") for i in range(50)]
    root = Scratch(spark, "t3").path("tokens")
    manifest = tf.write(documents(rows), root, FILE, shards=2)
    assert sorted(map(tuple, tf.documents(spark, root, manifest, step=3, task_tokens=20).collect())) == expected(rows)

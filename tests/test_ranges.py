"""Turtle files in ranges give what the whole file gives."""

import json
import pickle
import random

import pytest

from lattica.sources import ranges
from lattica.sources.turtle import parse_turtle, read_turtle, write_turtle

HARD = '''@prefix : <urn:t:> .
@prefix ex: <urn:x#> . # a comment . with "quotes""" and @prefix no: <urn:no> .
:a ex:p "one . two" , """long . text
@prefix : <urn:wrong> .
with ""quotes"" and \\"""escapes\\""" and #hash .
""" ; ex:q 1.5 , ex:d.ot .
# comment with """ open
PREFIX : <urn:second:>
:a ex:base <urn:b#.c> .
[ ex:p ( 1 2 [ ex:q "x" ] ) ; ex:r _:n ] .
base <urn:base/>
<rel> ex:p \'\'\'single """ long
.
\'\'\' .
@prefix
   ex:
   <urn:third#>
 .
_:n ex:p "prefix : <urn:no>" . :b ex:p "é一😀" , [] , [] . :c a ex:K; .
:d ex:p """a
b""", """"q""" .
'''


def planned(path, text, size):
    """The parts of a plan made without Spark."""
    data = text.encode()
    listed = [(path, len(data))]

    class Fake:
        def __init__(self):
            self.read = self

        def format(self, _):
            return self

        def option(self, _, value):
            self.value = value
            return self

        def load(self):
            return self

        def collect(self):
            from pyspark.sql import Row

            reader = ranges._ScanReader({"ranges": self.value})
            return [Row("range", "way", "first", "after", "directives")(*r) for p in reader.partitions() for r in reader.read(p)]

    return ranges.plan(Fake(), listed, size)


@pytest.mark.parametrize("size", [1, 7, 40, 100, 10_000])
def test_parts_say_what_the_whole_says(tmp_path, size):
    path = tmp_path / "hard.ttl"
    path.write_text(HARD, encoding="utf-8")
    parts = planned(str(path), HARD, size)
    rows = [r for p in parts for b in ranges._ParseReader({"ranges": "[]"}).read(ranges._Range(*p)) for r in zip(*[c.to_pylist() for c in b.columns])]
    assert rows == parse_turtle(HARD, str(path))
    assert [p[1] for p in parts[1:]] == [p[2] for p in parts[:-1]] and parts[-1][2] == len(HARD.encode())
    assert size > 100 or len(parts) > 4


def test_random_files(tmp_path):
    r = random.Random(2)
    pieces = ['"""', "'''", '"', "x", " . ", "\n", "# ", "é", "\\\"", "@prefix y: <urn:y> .", ";"]
    for n in range(60):
        text = "@prefix x: <urn:x> .\n"
        for i in range(r.randint(1, 12)):
            body = "".join(r.choices(pieces, k=r.randint(0, 12)))
            for quote in ('"""', "'''"):
                body = body.replace(quote, quote[0])
            body = body.replace("\\", "").replace('"', '\\"')
            text += f"x:s{i} x:p \"\"\"{body}\"\"\" ." + r.choice(["\n", " ", "\n# c \"\"\" '''\n"]) + (f"PREFIX x: <urn:v{i}>\n" if r.random() < 0.3 else "")
        path = tmp_path / f"{n}.ttl"
        path.write_text(text, encoding="utf-8")
        parts = planned(str(path), text, r.choice([3, 20, 60]))
        rows = [row for p in parts for b in ranges._ParseReader({"ranges": "[]"}).read(ranges._Range(*p)) for row in zip(*[c.to_pylist() for c in b.columns])]
        assert rows == parse_turtle(text, str(path)), text


def test_one_file_in_many_tasks(spark, tmp_path):
    path = tmp_path / "many.ttl"
    path.write_text(HARD + "".join(f'<urn:s{i}> <urn:p> """line\n{i} .\n""" .\n' for i in range(3000)), encoding="utf-8")
    got = read_turtle(spark, [f"file://{path}"], range_bytes=8_000)
    assert got.rdd.getNumPartitions() >= 1
    raw = ranges.read_ranges(spark, ranges.files(spark, [f"file://{path}"]), 8_000)
    assert raw.rdd.getNumPartitions() > 10
    whole = {tuple(r) for r in parse_turtle(path.read_text(encoding="utf-8"), ranges.files(spark, [f"file://{path}"])[0][0])}
    assert {tuple(r) for r in got.collect()} == whole


def test_written_turtle_reads_back(spark, tmp_path):
    rows = [("urn:a#x", "iri", "urn:a#p", o, "literal", None, lang) for o, lang in (('q"uo"""te\\', None), ("two\nlines\r\n", "en"), ("", None), ("tab\t'''", "zh-cn"))]
    rows += [("urn:a#x", "iri", "urn:a#p", "urn:b/1|2", "iri", None, None), ("urn:a#y", "iri", "urn:a#q", "5", "literal", "http://www.w3.org/2001/XMLSchema#integer", None)]
    triples = spark.createDataFrame(rows, ranges.TRIPLES)
    write_turtle(triples, str(tmp_path / "out"), {"a": "urn:a#"})
    got = read_turtle(spark, [str(tmp_path / "out")], range_bytes=50)
    want = {tuple(x.replace("|", "_") if isinstance(x, str) else x for x in r) for r in rows}
    assert {tuple(r) for r in got.collect()} == want


def test_repeated_directives_come_to_few(tmp_path):
    """Files whose statements say their prefixes: what a plan holds does not
    grow with the square of the file."""
    text = "".join(f'PREFIX a: <urn:a#>\nPREFIX b: <urn:b{i // 900}#>\na:s{i} b:p "{i}" .\n' for i in range(2000))
    path = tmp_path / "said.ttl"
    path.write_text(text, encoding="utf-8")
    parts = planned(str(path), text, 500)
    assert len(parts) > 200 and max(len(p[3]) for p in parts) < 100
    assert len(ranges._packed(parts, ranges._ParseReader.coded)) < 100 * len(parts)
    rows = [r for p in parts for b in ranges._ParseReader({"ranges": "[]"}).read(ranges._Range(*p)) for r in zip(*[c.to_pylist() for c in b.columns])]
    assert rows == parse_turtle(text, str(path))


@pytest.mark.parametrize("size", [1, 9, 50])
def test_relative_bases_and_prefixes(tmp_path, size):
    text = "@prefix r: <early/> .\n@base <urn:one/> .\n@prefix p: <x/> .\nbase <two/>\n<a> p:b r:c .\n@prefix q: <y/> . # c\n<d> q:e p:f .\n@base <urn:three/> .\n@prefix p: <z/> .\n<g> p:h q:i .\n<k> p:l [] .\n"
    path = tmp_path / "based.ttl"
    path.write_text(text, encoding="utf-8")
    parts = planned(str(path), text, size)
    rows = [r for p in parts for b in ranges._ParseReader({"ranges": "[]"}).read(ranges._Range(*p)) for r in zip(*[c.to_pylist() for c in b.columns])]
    assert rows == parse_turtle(text, str(path)) and ("urn:three/g", "iri", "urn:three/z/h", "urn:one/two/y/i", "iri", None, None) in rows


def test_tasks_get_their_own_ranges_alone(tmp_path):
    """What goes to every task does not grow with the ranges, and what comes to
    the driver is a row a task."""
    path = tmp_path / "long.ttl"
    path.write_text("PREFIX a: <urn:a#>\n" + "".join(f'a:s{i} a:p """{i}\n""" .\n' for i in range(5_000)), encoding="utf-8")
    size = path.stat().st_size
    cut = [(i, str(path), at, min(at + 40, size), size) for i, at in enumerate(range(0, size, 40))]
    for source, coded, given in ((ranges.TurtleScan, (1,), cut), (ranges.TurtleRanges, (0, 3), [(*r[1:4], "") for r in cut])):
        made = source({"ranges": ranges._packed(given, coded)})
        reader = made.reader(None)
        assert len(pickle.dumps((made, reader))) < 500
        parts = reader.partitions()
        assert [tuple(v) for p in parts for v in p.several] == given
    reader = ranges.TurtleScan({"ranges": ranges._packed(cut, (1,))}).reader(None)
    parts = reader.partitions()
    rows = [list(pickle.loads(pickle.dumps(reader)).read(p)) for p in parts]
    assert len(cut) > 2 * len(parts) and max(map(len, rows)) == 1
    assert sum(len(r[0][0]) for r in rows if r) < 120 * len(cut) and all(json.loads(r[0][0]) for r in rows if r)
    read = [row for p in planned(str(path), path.read_text(), 40) for b in ranges._ParseReader({"ranges": "[]"}).read(ranges._Range(*p)) for row in zip(*[c.to_pylist() for c in b.columns])]
    assert read == parse_turtle(path.read_text(), str(path))

"""One Turtle file in many tasks.

A file is cut into byte ranges at line ends. What a range means depends on what
stands before it: whether it begins inside a long string, and which prefixes are
known. So the file is read twice, by two data sources. The first scans each range
for the three ways in which it can begin (outside strings, or inside one of the
two kinds of long strings): where its first statement ends, how it ends itself,
and what its directives come to. Following these from range to range gives the
way in which each one begins and the prefixes that hold there; that is a few
values a range, on the driver, however often a file repeats its directives. The
second parses each range from its first statement end to that of the next range
that has one, with the prefixes that hold there. A task takes several ranges,
one after another, where there are many.

A line is never cut, so a file without line ends is one range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import ArrowInvalid, ArrowNotImplementedError, RecordBatch, array, string
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.plans.model import TRIPLES
from lattica.sources import turtle

#: Bytes of a range, and of what is read beyond it for a directive at its end.
RANGE, BEYOND = 32 << 20, 1 << 16
#: Tasks that the ranges are dealt to at most.
TASKS = 1_000

#: How a range begins: outside strings, or inside a long string of a quote.
WAYS = ("", '"""', "'''")

_REST = {'"""': re.compile(rb'(?:[^"\\]|\\.|"(?!""))*?"""', re.S), "'''": re.compile(rb"(?:[^'\\]|\\.|'(?!''))*?'''", re.S)}
_IRI = rb"<[^<>\"{}|^`\x00-\x20]*>"
_GAP = rb"(?:\s|\#[^\n]*\n)"
#: What may hide other marks, then directives, then a long string left open.
_MARKS = re.compile(
    rb"""(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*?\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*?''')
  | (?P<open>\"\"\"|''')
  | "(?:[^"\\\n\r]|\\.)*" | '(?:[^'\\\n\r]|\\.)*'
  | """ + _IRI + rb""" | \#[^\n]* | \\.
  | (?<![\w:.\-%\\"'])(?P<directive>(?:@prefix|(?i:prefix))""" + _GAP + rb"""+[^\s:]*:""" + _GAP + rb"*" + _IRI + rb"""|(?:@base|(?i:base))""" + _GAP + rb"*" + _IRI + rb")",
    re.X | re.S,
)

#: A directive that _MARKS found.
_DIRECTIVE = re.compile(r"@?(?:prefix(?:\s|\#[^\n]*\n)+(?P<name>[^\s:]*):|base)(?:\s|\#[^\n]*\n)*<(?P<iri>[^<>]*)>", re.I | re.S)


def filesystem(path: str) -> tuple[FileSystem, str]:
    if re.match(r"file:/|/", path):
        return LocalFileSystem(), re.sub("^file:/+", "/", path)
    return FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether tasks can open ranges of the file themselves."""
    try:
        filesystem(path)
    except (ArrowInvalid, ArrowNotImplementedError, OSError):
        return False
    return True


def files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of all files at or below the paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        every = where.getFileSystem(conf).listFiles(where, True)
        while every.hasNext():
            f = every.next()
            if not re.match("[_.]", f.getPath().getName()) and f.getLen():
                found[f.getPath().toString()] = f.getLen()
    return sorted(found.items())


def _line_end(file, at: int, size: int) -> int:
    """The first place after ``at`` at which a line begins."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    at -= 1
    file.seek(at)
    while block := file.read(BEYOND):
        if (found := block.find(b"\n")) >= 0:
            return at + found + 1
        at += len(block)
    return size


def first_end(data: bytes) -> int | None:
    """Bytes up to the end of the first statement, from outside strings."""
    step = 1 << 20
    while True:
        text = data[:step].decode("utf-8", "ignore")
        at = 0
        while at < len(text):
            m = turtle.TOKEN.match(text, at)
            whole = step >= len(data) or (m and m.end() < len(text) - 1)
            if not whole:
                break
            at = m.end() if m else at + 1
            if m and m.lastgroup == "op" and m.group() == ".":
                return len(text[:at].encode())
        if step >= len(data):
            return None
        step *= 16


def scan(data: bytes, beyond: bytes, way: str) -> tuple[int | None, str, list[tuple[int, str]]]:
    """(first statement end, how the range ends, directives and their places) of
    a range that begins in the given way."""
    at = 0
    if way:
        m = _REST[way].match(data)
        if not m:
            return None, way, []
        at = m.end()
    directives, after, stop = [], "", len(data)
    for m in _MARKS.finditer(data + beyond, at):
        if m.start() >= len(data):
            break
        if m.lastgroup == "directive":
            directives.append((m.start(), m.group().decode() + (" ." if m.group()[:1] == b"@" else "")))
        elif m.lastgroup == "open" or (m.lastgroup == "long" and m.end() > len(data)):
            after, stop = m.group()[:3].decode(), m.start()
            break
    end = first_end(data[at:stop])
    return None if end is None else at + end, after, directives


def changes(directives: list[str]) -> tuple[dict[str, tuple[bool, str]], tuple[bool, str]]:
    """What directives come to: the prefixes that they leave and the base, each
    with whether it continues the base that held before them."""
    prefixes, base = {}, (True, "")
    for text in directives:
        m = _DIRECTIVE.match(text)
        value = (False, m["iri"]) if _absolute(m["iri"]) else (base[0], base[1] + m["iri"])
        if m["name"] is None:
            base = value
        else:
            prefixes[m["name"]] = value
    return prefixes, base


def _absolute(iri: str) -> bool:
    try:
        iri = turtle._plain(iri)
    except turtle.TurtleError:  # an error of its reader, if the range begins so
        pass
    return re.match(r"[A-Za-z][\w+.-]*:", iri) is not None


def after(state: tuple[dict[str, str], str], made) -> tuple[dict[str, str], str]:
    """The prefixes and the base that hold after changes."""
    (prefixes, base), (named, last) = state, made
    whole = lambda v: base + v[1] if v[0] else v[1]
    return prefixes | {n: whole(v) for n, v in named.items()}, whole(last)


def said(state: tuple[dict[str, str], str]) -> str:
    """Directives that make the prefixes and the base, in this order: a relative
    prefix was made before the base."""
    prefixes, base = state
    return "\n".join([f"@prefix {n}: <{iri}> ." for n, iri in prefixes.items()] + ([f"@base <{base}> ."] if base else []))


class _Range(InputPartition):
    """One range, or several of a task."""

    def __init__(self, *value, several: list | None = None):
        super().__init__(value)
        self.several = several or [value]


class _Reader(DataSourceReader):
    """Ranges come as lists of values; those at the places ``coded`` are numbers
    of texts, which come once each (see ``_packed``)."""

    coded: tuple[int, ...] = ()

    def __init__(self, options):
        self.texts, self.ranges = json.loads(options["ranges"]) or ([], [])

    def __getstate__(self) -> dict:
        """Every task gets the reader, and reads the ranges of its partition alone."""
        return {}

    def partitions(self) -> list[InputPartition]:
        whole = [[self.texts[v] if i in self.coded else v for i, v in enumerate(r)] for r in self.ranges]
        step = -(-len(whole) // TASKS) or 1
        return [_Range(*whole[at], several=whole[at : at + step]) for at in range(0, len(whole), step)]


class _ScanReader(_Reader):
    coded = (1,)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """One row a task: of each of its ranges and ways the number, the way,
        the first statement end, how it ends and the place among the texts of
        what its directives come to."""
        texts: dict[str, int] = {}
        found = []
        for number, path, start, end, size in partition.several:
            fs, inner = filesystem(path)
            with fs.open_input_file(inner) as file:
                begin, stop = _line_end(file, start, size), _line_end(file, end, size)
                file.seek(begin)
                data = file.read(stop - begin)
                beyond = file.read(BEYOND)
            for way in WAYS if data else ():
                first, ends, directives = scan(data, beyond, way)
                # What holds at the first statement end, and at the end of the range.
                ahead = changes([text for at, text in directives if first is None or at < first])
                made = json.dumps([ahead, changes([text for _, text in directives])])
                found.append([number, WAYS.index(way), None if first is None else begin + first, WAYS.index(ends), texts.setdefault(made, len(texts))])
        if found:
            yield (json.dumps([list(texts), found], separators=(",", ":")),)


def _found(row: str) -> dict[tuple[int, str], tuple]:
    """(first statement end, how it ends, what its directives come to) by range
    and way, in the order of the ranges, from a task's row."""
    texts, found = json.loads(row)
    made = [json.loads(t) for t in texts]
    return {(number, WAYS[way]): (first, WAYS[ends], made[at]) for number, way, first, ends, at in found}


class _ParseReader(_Reader):
    coded = (0, 3)

    def read(self, partition: InputPartition) -> Iterator[RecordBatch]:
        for path, start, end, directives in partition.several:
            fs, inner = filesystem(path)
            with fs.open_input_file(inner) as file:
                file.seek(start)
                text = file.read(end - start).decode()
            for rows in turtle.statements(text, path, start, directives):
                yield RecordBatch.from_arrays([array(c, string()) for c in zip(*rows)], TRIPLES.fieldNames())


def _taken(options: dict) -> dict:
    """The ranges, no longer among the options: the source goes to every task."""
    return {"ranges": options.pop("ranges")}


class TurtleScan(DataSource):
    """How each range may begin and end."""

    @classmethod
    def name(cls) -> str:
        return "turtle_scan"

    def schema(self) -> str:
        return "found string"

    def reader(self, schema) -> DataSourceReader:
        return _ScanReader(_taken(self.options))


class TurtleRanges(DataSource):
    """The statements of planned ranges."""

    @classmethod
    def name(cls) -> str:
        return "turtle_ranges"

    def schema(self):
        return TRIPLES

    def reader(self, schema) -> DataSourceReader:
        return _ParseReader(_taken(self.options))


def _packed(ranges: list[tuple], coded: tuple[int, ...]) -> str:
    """The ranges for a reader, each text once."""
    texts: dict[str, int] = {}
    rows = [[texts.setdefault(v, len(texts)) if i in coded else v for i, v in enumerate(r)] for r in ranges]
    return json.dumps([list(texts), rows])


def plan(spark: SparkSession, listed: list[tuple[str, int]], size: int = RANGE) -> list[tuple[str, int, int, str]]:
    """(path, start, end, directives that hold there) of what each task parses."""
    cut = ((path, at, min(at + size, whole), whole) for path, whole in listed for at in range(0, whole, size))
    numbered = [(i, *r) for i, r in enumerate(cut)]
    several = [r for r in numbered if r[4] > size]
    seen: dict[tuple[int, str], tuple] = {}
    tasks, last = iter(()), -1
    if several:
        scanned = spark.read.format("turtle_scan").option("ranges", _packed(several, _ScanReader.coded)).load()
        tasks = (r[0] for r in scanned.collect())  # in the order of the ranges; taken apart one after the other
    out: list[tuple[str, int, int, str]] = []
    none = ({}, "")
    way, state, begun, head, path = "", none, 0, "", None
    for number, file, at, end, whole in numbered:
        if file != path:
            path, way, state, begun, head = file, "", none, 0, ""
        if number > last and (row := next(tasks, None)):
            seen = _found(row)
            last = max(n for n, _ in seen)
        first, way, made = seen.get((number, way), (None, way, None))
        if at and first is not None and first > begun:
            out.append((path, begun, first, head))
            now = said(after(state, made[0]))
            begun, head = first, head if now == head else now
        state = after(state, made[1]) if made else state
        if end == whole and begun < whole:
            out.append((path, begun, whole, head))
    return out


def read_ranges(spark: SparkSession, listed: list[tuple[str, int]], size: int = RANGE) -> DataFrame:
    for source in (TurtleScan, TurtleRanges):
        spark.dataSource.register(source)
    return spark.read.format("turtle_ranges").option("ranges", _packed(plan(spark, listed, size), _ParseReader.coded)).load()

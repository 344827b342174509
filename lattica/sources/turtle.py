"""Turtle and N-Triples files as a set of triples.

Prefixes and statements of Turtle span lines; ``ranges`` cuts a file into parts
all the same, and files in stores that only Spark opens are dealt out whole, one
a row. N-Triples are read line by line with built-in functions. Blank nodes are
renamed by file. The union is a set.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.model import RDF, TRIPLES, XSD
from lattica.sources.catalog import exists

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<directive>@prefix\b|@base\b)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<blank>_:[\w](?:[\w.-]*[\w-])?)
  | (?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<op>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
#: The escapes of strings.
_CHARS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def _plain(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] in "uU" and len(e) > 1:
            return chr(int(e[1:], 16))
        if e not in _CHARS:
            raise TurtleError(f"unknown escape \\{e}")
        return _CHARS[e]

    return _ESCAPE.sub(one, text)


class _Reader:
    """Recursive descent over the tokens of a file, or of a part of one that
    begins at byte ``at`` and after the given directives."""

    def __init__(self, text: str, file: str, at: int = 0, directives: str = ""):
        self.out: list[tuple] = []
        self.prefixes: dict[str, str] = {}
        self.base = ""
        if directives:
            ahead = _Reader(directives, file)
            list(ahead.document())
            self.prefixes, self.base = ahead.prefixes, ahead.base
        self.mark = hashlib.md5(file.encode()).hexdigest()[:8]
        self.whole, self.read, self.at = text, 0, at
        self.count = 0
        self.tokens = self._scan(text)
        self.kind, self.text, self.place = next(self.tokens)

    def _scan(self, text: str) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"unexpected text at {at}: {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                yield m.lastgroup, m.group(), at
            at = m.end()
        yield "end", "", at

    def step(self) -> str:
        text = self.text
        if self.kind != "end":
            self.kind, self.text, self.place = next(self.tokens)
        return text

    def need(self, op: str) -> None:
        if self.text != op:
            raise TurtleError(f"expected {op!r}, found {self.text!r}")
        self.step()

    def iri(self) -> str:
        if self.kind == "iri":
            inner = _plain(self.step()[1:-1])
            return inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else self.base + inner
        if self.kind == "name":
            prefix, _, local = self.step().partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"expected an address, found {self.text!r}")

    def fresh(self) -> tuple:
        """A node without a name, named by its statement's byte in the file, so
        that parts of a file give the names that the whole gives."""
        self.at += len(self.whole[self.read : self.began].encode())
        self.read = self.began
        self.count += 1
        return (f"_:{self.mark}g{self.at}-{self.count}", "bnode", None, None)

    def document(self) -> Iterator[list[tuple]]:
        """The statements, some thousand at a time."""
        while self.kind != "end":
            if len(self.out) >= 10_000:
                yield self.out
                self.out = []
            self.began, self.count = self.place, 0
            if self.kind == "directive" or (self.kind == "word" and self.text.upper() in ("PREFIX", "BASE")):
                word, dotted = self.step(), self.text
                dotted = word.startswith("@")
                if word.upper().endswith("PREFIX"):
                    name = self.step()
                    if not name.endswith(":"):
                        raise TurtleError(f"{name!r} is no prefix")
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if dotted:
                    self.need(".")
                continue
            anonymous = self.text == "["
            subject = self.term()
            if subject[1] == "literal":
                raise TurtleError("a literal is no subject")
            if not (anonymous and self.text == "."):
                self.predicates(subject)
            self.need(".")
        if self.out:
            yield self.out

    def predicates(self, subject: tuple) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self.step()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.say(subject, p, self.term())
                if self.text != ",":
                    break
                self.step()
            if self.text != ";":
                return
            while self.text == ";":
                self.step()
            if self.text in (".", "]"):
                return

    def say(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((s[0], s[1], p, o[0], o[1], o[2], o[3]))

    def term(self) -> tuple:
        """(value, kind, datatype, language)."""
        if self.text == "[":
            self.step()
            node = self.fresh()
            if self.text != "]":
                self.predicates(node)
            self.need("]")
            return node
        if self.text == "(":
            self.step()
            items = []
            while self.text != ")":
                items.append(self.term())
            self.step()
            nil = (RDF + "nil", "iri", None, None)
            nodes = [self.fresh() for _ in items] + [nil]
            for node, item, after in zip(nodes, items, nodes[1:]):
                self.say(node, RDF + "first", item)
                self.say(node, RDF + "rest", after)
            return nodes[0]
        if self.kind == "blank":
            return (f"_:{self.mark}n{self.step()[2:]}", "bnode", None, None)
        if self.kind == "string":
            raw = self.step()
            quote = 3 if raw[:3] in ('"""', "'''") else 1
            value = _plain(raw[quote:-quote])
            if self.kind == "lang":
                return (value, "literal", None, self.step()[1:].lower())
            if self.text == "^^":
                self.step()
                kind = self.iri()
                return (value, "literal", None if kind == XSD + "string" else kind, None)
            return (value, "literal", None, None)
        if self.kind == "number":
            n = self.step()
            kind = "double" if "e" in n.lower() else "decimal" if "." in n else "integer"
            return (n, "literal", XSD + kind, None)
        if self.kind == "word" and self.text in ("true", "false"):
            return (self.step(), "literal", XSD + "boolean", None)
        return (self.iri(), "iri", None, None)


def parse_turtle(text: str, file: str = "") -> list[tuple]:
    """The statements of a text as rows of ``TRIPLES``."""
    return [row for rows in statements(text, file) for row in rows]


def statements(text: str, file: str = "", at: int = 0, directives: str = "") -> Iterator[list[tuple]]:
    """The same in pieces, of a part of a file too."""
    return _Reader(text, file, at, directives).document()


def read_turtle(spark: SparkSession, paths: list[str], range_bytes: int | None = None) -> DataFrame:
    """The union of Turtle files as a set. Missing files are passed over; it is
    an error if none is there. A file larger than a range is read by several
    tasks."""
    from lattica.sources import ranges

    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"none of these graph files exists: {', '.join(paths)}")
    if all(ranges.reachable(p) for p in there):
        return ranges.read_ranges(spark, ranges.files(spark, there), range_bytes or ranges.RANGE).distinct()
    files = spark.read.format("text").option("wholetext", True).load(there).select("value", F.input_file_name().alias("file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, file in zip(batch["value"], batch["file"]):
                for rows in statements(text, file):
                    yield pd.DataFrame(rows, columns=TRIPLES.fieldNames(), dtype=object)

    return files.mapInPandas(run, TRIPLES).distinct()


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Triples as Turtle files, a subject a statement, in short names where a
    prefix fits. Files can be cut anywhere, so each statement says its prefixes."""
    def name(value: Column) -> Column:
        out = F.concat(F.lit("<"), F.regexp_replace(value, r"[<>\"{}|^`\\\x00-\x20]", "_"), F.lit(">"))
        for short, full in prefixes.items():
            local = F.substr(value, F.lit(len(full) + 1))
            out = F.when(value.startswith(full) & local.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(F.lit(f"{short}:"), local)).otherwise(out)
        return out

    text = F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    text = F.replace(text, F.lit("\r"), F.lit("\\r"))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^"), name(F.col("o_datatype")))).otherwise("")
    literal = F.concat(F.lit('"""'), text, F.lit('"""'), tail)
    node = lambda kind, value: F.when(kind == "bnode", value).otherwise(name(value))
    said = triples.select(node(F.col("s_kind"), F.col("s")).alias("s"), name(F.col("p")).alias("p"), F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o_kind"), F.col("o"))).alias("o"))
    head = "".join(f"PREFIX {short}: <{full}>\n" for short, full in prefixes.items())
    listed = said.groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), " , ").alias("o"))
    whole = listed.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ").alias("po"))
    whole.select(F.concat(F.lit(head), "s", F.lit(" "), "po", F.lit(" .")).alias("value")).write.mode("overwrite").text(path)


#: One statement of N-Triples: subject, predicate, then an address, a blank
#: node, or a string with a language or a type.
_LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s*<([^>]*)>\s*(?:<([^>]*)>|(_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """N-Triples files, in parallel by line. A line that is neither blank, a
    comment nor a statement is an error."""
    return _lines(spark, paths, _LINE)[0].select(TRIPLES.fieldNames()).distinct()


#: The same with the address or blank node of a graph before the full stop.
_QUAD = _LINE.replace(r"\s*\.\s*(?:#", r"\s*(?:<([^>]*)>|(_:[^\s.]+))?\s*\.\s*(?:#")


def read_nquads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """N-Quads files likewise, with a column ``graph``: null for statements of the
    default graph."""
    rows, part, blank = _lines(spark, paths, _QUAD)
    return rows.select(*TRIPLES.fieldNames(), F.coalesce(part(9), blank(10)).alias("graph")).distinct()


def _lines(spark: SparkSession, paths: list[str], pattern: str) -> tuple:
    """The statements of lines beside their text, and what reads further groups."""
    lines = spark.read.text(paths).select("value", F.substring(F.md5(F.input_file_name()), 1, 8).alias("mark")).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    blank = lambda i: F.concat(F.lit("_:"), F.col("mark"), F.lit("n"), F.substr(part(i), F.lit(3)))
    text = F.regexp_extract("value", pattern, 6)
    for mark, plain in (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'")):
        text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\" + mark, "$1" + plain)
    text = F.when(text.rlike(r"\\[uU]"), _code_points(text)).otherwise(text)
    text = F.replace(text, F.lit("\\\\"), F.lit("\\"))
    bad = F.when(~F.col("value").rlike(pattern), F.raise_error(F.concat(F.lit("no statement: "), F.col("value"))).cast("string"))
    o_kind = F.when(part(4).isNotNull(), "iri").when(part(5).isNotNull(), "bnode").otherwise("literal")
    rows = lines.select(
        "value", "mark",
        F.coalesce(bad, part(1), blank(2)).alias("s"), F.when(part(1).isNotNull(), "iri").otherwise("bnode").alias("s_kind"), part(3).alias("p"),
        F.when(part(4).isNotNull(), part(4)).when(part(5).isNotNull(), blank(5)).otherwise(text).alias("o"), o_kind.alias("o_kind"),
        F.when(part(8) != XSD + "string", part(8)).alias("o_datatype"), F.lower(part(7)).alias("o_lang"),
    )
    return rows, part, blank


def _code_points(text):
    """\\uXXXX and \\UXXXXXXXX replaced by their characters."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"), F.lit(0)))

    def one(t, c):
        char = F.decode(F.unhex(F.lpad(F.substr(c, F.lit(3)), 8, "0")), "UTF-32")
        return F.replace(t, c, char)

    return F.aggregate(codes, text, one)

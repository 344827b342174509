"""Lexer and recursive-descent parser of SPARQL 1.1 SELECT."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lattica.plans.model import RDF, XSD


class SparqlError(ValueError):
    pass


# --- syntax tree ------------------------------------------------------------------


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str = ""
    lang: str = ""


@dataclass(frozen=True)
class Path:
    """op is iri, inv, seq, alt, star, plus, opt or neg."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Call:
    """An operator or function; ``name`` in upper case."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object  # None for *
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    group: list
    negated: bool

    __hash__ = object.__hash__


@dataclass
class Query:
    items: list[tuple[object, str]] | None  # (expression, name); None for *
    where: list
    distinct: bool = False
    group: list[tuple[object, str | None]] = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0
    values: tuple | None = None
    sources: list[tuple[str, bool]] = field(default_factory=list)  # (graph, whether FROM NAMED)


# --- tokens --------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<blank>_:[\w.-]*\w)
  | (?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] in "uU":
            return chr(int(e[1:], 16))
        if e not in _ESCAPES:
            raise SparqlError(f"unknown escape \\{e}")
        return _ESCAPES[e]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return [*out, ("end", "")]


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
_COMPARE = {"=", "!=", "<", ">", "<=", ">="}


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.prefixes, self.base, self.blanks = tokens(text), 0, {}, "", 0

    # helpers
    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return (value.upper() if kind == "word" else value) in values and kind in ("word", "op")

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need(self, *values: str) -> str:
        if (got := self.take(*values)) is None:
            raise SparqlError(f"expected {' or '.join(values)}, found {self.tokens[self.at][1] or 'the end'!r}")
        return got

    def kind(self, kind: str) -> str | None:
        if self.tokens[self.at][0] == kind:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def iri(self) -> str | None:
        if (i := self.kind("iri")) is not None:
            return i[1:-1] if re.match(r"[A-Za-z][\w+.-]*:", i[1:-1]) else self.base + i[1:-1]
        if (n := self.kind("name")) is not None:
            prefix, _, local = n.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + local
        return None

    def integer(self) -> int:
        if (n := self.kind("number")) is None or not n.isdigit():
            raise SparqlError("expected a whole number")
        return int(n)

    def fresh(self) -> Var:
        self.blanks += 1
        return Var(f"_blank{self.blanks}")

    # query
    def query(self) -> Query:
        while True:
            if self.take("PREFIX"):
                name, iri = self.kind("name"), self.kind("iri")
                if name is None or iri is None or not name.endswith(":"):
                    raise SparqlError("a prefix needs a name and an address")
                self.prefixes[name[:-1]] = iri[1:-1]
            elif self.take("BASE"):
                self.base = (self.kind("iri") or "<>")[1:-1]
            else:
                break
        if not self.peek("SELECT"):
            raise SparqlError("only SELECT queries are supported")
        q = self.select()
        if self.tokens[self.at][0] != "end":
            raise SparqlError(f"unexpected {self.tokens[self.at][1]!r}")
        return q

    def select(self) -> Query:
        self.need("SELECT")
        distinct = self.take("DISTINCT", "REDUCED") == "DISTINCT"
        items: list | None = []
        if self.take("*"):
            items = None
        else:
            while True:
                if v := self.kind("var"):
                    items.append((Var(v[1:]), v[1:]))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    v = self.kind("var")
                    if not v:
                        raise SparqlError("AS needs a variable")
                    items.append((e, v[1:]))
                    self.need(")")
                else:
                    break
            if not items:
                raise SparqlError("SELECT needs variables")
        sources: list = []
        while self.take("FROM"):
            named = self.take("NAMED") is not None
            if (i := self.iri()) is None:
                raise SparqlError("FROM needs an address")
            sources.append((i, named))
        self.take("WHERE")
        q = Query(items, self.group(), distinct, sources=sources)
        if self.take("GROUP"):
            self.need("BY")
            while True:
                if v := self.kind("var"):
                    q.group.append((Var(v[1:]), v[1:]))
                elif self.take("("):
                    e, name = self.expression(), None
                    if self.take("AS"):
                        name = (self.kind("var") or "? ")[1:]
                    self.need(")")
                    q.group.append((e, name))
                else:
                    break
        if self.take("HAVING"):
            while self.peek("("):
                q.having.append(self.constraint())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if way := self.take("ASC", "DESC"):
                    self.need("(")
                    q.order.append((self.expression(), way == "ASC"))
                    self.need(")")
                elif v := self.kind("var"):
                    q.order.append((Var(v[1:]), True))
                elif self.peek("("):
                    q.order.append((self.constraint(), True))
                else:
                    break
        while word := self.take("LIMIT", "OFFSET"):
            if word == "LIMIT":
                q.limit = self.integer()
            else:
                q.offset = self.integer()
        if self.take("VALUES"):
            q.values = self.data()
        return q

    # patterns
    def group(self) -> list:
        self.need("{")
        out: list = []
        if self.peek("SELECT"):
            out.append(("sub", q := self.select()))
            if q.sources:
                raise SparqlError("FROM belongs to the outermost SELECT")
            self.need("}")
            return out
        while not self.take("}"):
            if self.take("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take("MINUS"):
                out.append(("minus", self.group()))
            elif self.take("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                v = self.kind("var")
                if not v:
                    raise SparqlError("BIND needs a variable")
                self.need(")")
                out.append(("bind", e, v[1:]))
            elif self.take("VALUES"):
                out.append(("values", *self.data()))
            elif self.peek("{"):
                arms = [self.group()]
                while self.take("UNION"):
                    arms.append(self.group())
                out.append(("union", arms) if len(arms) > 1 else ("group", arms[0]))
            elif self.take("GRAPH"):
                name = self.term()
                if not isinstance(name, (Var, Iri)):
                    raise SparqlError("GRAPH needs an address or a variable")
                out.append(("graph", name, self.group()))
            elif self.peek("SERVICE"):
                raise SparqlError("SERVICE is not supported")
            else:
                found: list = []
                self.triples(found)
                if out and out[-1][0] == "bgp":
                    out[-1][1].extend(found)
                else:
                    out.append(("bgp", found))
            self.take(".")
        return out

    def data(self) -> tuple:
        if v := self.kind("var"):
            names, single = [v[1:]], True
        else:
            self.need("(")
            names, single = [], False
            while v := self.kind("var"):
                names.append(v[1:])
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if not single:
                self.need("(")
            row = [None if self.take("UNDEF") else self.term() for _ in names]
            if not single:
                self.need(")")
            rows.append(row)
        return names, rows

    def triples(self, out: list) -> None:
        subject = self.node(out)
        if self.peek(".", "}") and isinstance(subject, Var) and subject.name.startswith("_blank"):
            return
        self.predicates(subject, out)

    def predicates(self, subject, out: list) -> None:
        while True:
            if v := self.kind("var"):
                p: object = Var(v[1:])
            else:
                p = self.path()
            while True:
                out.append((subject, p, self.node(out)))
                if not self.take(","):
                    break
            while self.take(";"):
                more = True
                if self.peek(".", "}", "]", ";"):
                    more = False
                if more:
                    break
            else:
                return
            if not more:
                return

    def node(self, out: list):
        if self.take("["):
            v = self.fresh()
            if not self.take("]"):
                self.predicates(v, out)
                self.need("]")
            return v
        return self.term()

    def term(self):
        if v := self.kind("var"):
            return Var(v[1:])
        if b := self.kind("blank"):
            return Var("_blank:" + b[2:])
        if (i := self.iri()) is not None:
            return Iri(i)
        return self.literal()

    def literal(self) -> Lit:
        if s := self.kind("string"):
            quote = 3 if s[:3] in ('"""', "'''") else 1
            value = unescape(s[quote:-quote])
            if lang := self.kind("lang"):
                return Lit(value, "", lang[1:].lower())
            if self.take("^^"):
                kind = self.iri() or ""
                return Lit(value, "" if kind == XSD + "string" else kind)
            return Lit(value)
        sign = self.take("+", "-") or ""
        if n := self.kind("number"):
            kind = "double" if "e" in n.lower() else "decimal" if "." in n else "integer"
            return Lit(sign.replace("+", "") + n, XSD + kind)
        if word := self.take("TRUE", "FALSE"):
            return Lit(word.lower(), XSD + "boolean")
        raise SparqlError(f"expected a term, found {self.tokens[self.at][1]!r}")

    # paths
    def path(self) -> Path:
        arms = [self.sequence()]
        while self.take("|"):
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else Path("alt", tuple(arms))

    def sequence(self) -> Path:
        steps = [self.step()]
        while self.take("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else Path("seq", tuple(steps))

    def step(self) -> Path:
        inverse = self.take("^") is not None
        if self.take("("):
            p = self.path()
            self.need(")")
        elif self.take("!"):
            many, names = self.take("("), []
            while True:
                back = self.take("^") is not None
                names.append((self.predicate(), back))
                if not (many and self.take("|")):
                    break
            if many:
                self.need(")")
            p = Path("neg", tuple(names))
        else:
            p = Path("iri", (self.predicate(),))
        if (mark := self.take("*", "+", "?")) is not None:
            p = Path({"*": "star", "+": "plus", "?": "opt"}[mark], (p,))
        return Path("inv", (p,)) if inverse else p

    def predicate(self) -> str:
        kind, value = self.tokens[self.at]
        if kind == "word" and value == "a":
            self.at += 1
            return RDF + "type"
        if (i := self.iri()) is None:
            raise SparqlError(f"expected a predicate, found {value!r}")
        return i

    # expressions
    def constraint(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        return self.chain("||", lambda: self.chain("&&", self.comparison))

    def chain(self, op: str, inner):
        e = inner()
        while self.take(op):
            e = Call(op, (e, inner()))
        return e

    def comparison(self):
        e = self.sum()
        for op in _COMPARE:
            if self.take(op):
                return Call(op, (e, self.sum()))
        negated = self.take("NOT") is not None
        if self.take("IN"):
            found = Call("IN", (e, *self.arguments()))
            return Call("!", (found,)) if negated else found
        if negated:
            raise SparqlError("expected IN")
        return e

    def sum(self):
        e = self.product()
        while op := self.take("+", "-"):
            e = Call(op, (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while op := self.take("*", "/"):
            e = Call(op, (e, self.unary()))
        return e

    def unary(self):
        if self.take("!"):
            return Call("!", (self.unary(),))
        if self.take("-"):
            return Call("NEG", (self.unary(),))
        if self.take("+"):
            return self.unary()
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("NOT"):
            self.need("EXISTS")
            return Exists(self.group(), True)
        if self.take("EXISTS"):
            return Exists(self.group(), False)
        kind, value = self.tokens[self.at]
        if kind == "word" and value.upper() not in ("TRUE", "FALSE"):
            self.at += 1
            name = value.upper()
            if name in AGGREGATES:
                return self.aggregate(name)
            return Call(name, tuple(self.arguments()))
        term = self.term()
        if isinstance(term, Iri) and self.peek("("):
            return Call("CAST", (term, *self.arguments()))
        return term

    def aggregate(self, name: str) -> Aggregate:
        self.need("(")
        distinct, separator = self.take("DISTINCT") is not None, " "
        arg = None if self.take("*") else self.expression()
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.literal().value
        self.need(")")
        return Aggregate(name, arg, distinct, separator)


def parse(text: str) -> Query:
    return _Parser(text).query()

"""Expressions over solutions, as columns.

A value is a term (struct), a string, a number or a boolean; an error is NULL,
so that AND and OR follow SPARQL's three-valued logic by SQL's own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.plans.model import XSD
from lattica.plans.sparql.syntax import Aggregate, Call, Exists, Iri, Lit, SparqlError, Var

NUMERIC = [XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]
WHOLE = [XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]


@dataclass
class Value:
    kind: str  # term, string, number, whole or boolean
    col: Column
    lang: Column | None = None


def has_aggregate(e) -> bool:
    return isinstance(e, Aggregate) or any(has_aggregate(a) for a in getattr(e, "args", ()))


def _literal(value: Column, datatype: str = "", lang: Column | None = None) -> Column:
    made = F.struct(F.lit("l").alias("k"), value.alias("v"), F.lit(datatype).alias("d"), (lang if lang is not None else F.lit("")).alias("g"))
    return F.when(value.isNotNull(), made)


def _number_text(n: Column) -> Column:
    """Whole numbers without a point."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), F.floor(n).cast("string")).otherwise(n.cast("string"))


class Scope:
    """Where expressions find their variables."""

    def __init__(self, rel, compiler, columns: dict[str, Column] | None = None):
        self.rel, self.compiler, self.columns = rel, compiler, columns

    def variable(self, name: str) -> Column:
        if name not in self.rel.names:
            return F.lit(None).cast("struct<k: string, v: string, d: string, g: string>")
        return self.columns[name] if self.columns else F.col(f"v_{name}")

    # --- views of a value -------------------------------------------------------

    def value(self, e) -> Value:
        if isinstance(e, Var):
            return Value("term", self.variable(e.name))
        if isinstance(e, Iri):
            return Value("term", F.struct(F.lit("i").alias("k"), F.lit(e.value).alias("v"), F.lit("").alias("d"), F.lit("").alias("g")))
        if isinstance(e, Lit):
            if e.datatype in NUMERIC:
                return Value("whole" if e.datatype in WHOLE else "number", F.lit(float(e.value)))
            if e.datatype == XSD + "boolean":
                return Value("boolean", F.lit(e.value in ("true", "1")))
            if not e.datatype and not e.lang:
                return Value("string", F.lit(e.value))
            return Value("term", F.struct(F.lit("l").alias("k"), F.lit(e.value).alias("v"), F.lit(e.datatype).alias("d"), F.lit(e.lang).alias("g")))
        if isinstance(e, Aggregate):
            raise SparqlError(f"{e.name} is not allowed here")
        if isinstance(e, Exists):
            raise SparqlError("EXISTS is supported as a filter or a conjunct of one")
        return self.call(e)

    def term(self, e) -> Column:
        v = self.value(e)
        if v.kind == "term":
            return v.col
        if v.kind == "string":
            return _literal(v.col, "", v.lang)
        if v.kind == "boolean":
            return _literal(v.col.cast("string"), XSD + "boolean")
        if v.kind == "whole":
            return _literal(_number_text(v.col), XSD + "integer")
        return _literal(_number_text(v.col), XSD + "decimal")

    def string(self, e) -> Column:
        v = self.value(e)
        if v.kind == "term":
            return v.col["v"]
        return _number_text(v.col) if v.kind in ("number", "whole") else v.col.cast("string")

    def text(self, e) -> Column:
        """The text of a string literal; an error for other terms."""
        v = self.value(e)
        if v.kind == "term":
            return F.when(v.col["k"] == "l", v.col["v"])
        return self.string(e)

    def number(self, e) -> Column:
        v = self.value(e)
        if v.kind == "term":
            return F.when(v.col["d"].isin(NUMERIC), v.col["v"].try_cast("double"))
        return v.col.try_cast("double") if v.kind in ("number", "whole") else F.lit(None).cast("double")

    def truth(self, e) -> Column:
        v = self.value(e)
        if v.kind == "boolean":
            return v.col
        if v.kind in ("number", "whole"):
            return v.col != 0
        if v.kind == "string":
            return v.col != ""
        t = v.col
        plain = F.when((t["k"] == "l") & (t["d"] == ""), t["v"] != "")
        return F.when(t["d"] == XSD + "boolean", t["v"].isin("true", "1")).when(t["d"].isin(NUMERIC), t["v"].try_cast("double") != 0).otherwise(plain)

    def order(self, e) -> list[Column]:
        """Unbound, blank nodes, IRIs, literals; numbers by value."""
        t = self.term(e)
        rank = F.when(t.isNull(), 0).when(t["k"] == "b", 1).when(t["k"] == "i", 2).otherwise(3)
        number = F.when(t["d"].isin(NUMERIC), t["v"].try_cast("double"))
        return [rank, number, F.coalesce(t["v"], F.lit(""))]

    # --- comparisons ----------------------------------------------------------------

    def equal(self, a, b) -> Column:
        x, y = self.value(a), self.value(b)
        if "boolean" in (x.kind, y.kind):
            return self.truth(a) == self.truth(b)
        if x.kind in ("number", "whole") or y.kind in ("number", "whole"):
            return self.number(a) == self.number(b)
        if x.kind == y.kind == "string":
            return x.col == y.col
        same = self.term(a) == self.term(b)
        if x.kind == y.kind == "term":
            both = x.col["d"].isin(NUMERIC) & y.col["d"].isin(NUMERIC)
            return F.when(both, self.number(a) == self.number(b)).otherwise(same)
        return same

    def key(self, e) -> Column | None:
        """What equal values have in common: the number, or else the text. None
        for truth values, which have no such text."""
        v = self.value(e)
        if v.kind == "boolean":
            return None
        number = lambda n: F.concat(F.lit("n"), (n + F.lit(0.0)).cast("string"))
        if v.kind in ("number", "whole"):
            return number(v.col.try_cast("double"))
        if v.kind == "string":
            return F.concat(F.lit("t"), v.col)
        return F.coalesce(number(self.number(e)), F.concat(F.lit("t"), v.col["v"]))

    def less(self, a, b, op: str) -> Column:
        compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        x, y = self.value(a), self.value(b)
        if {"number", "whole"} & {x.kind, y.kind}:
            return compare(self.number(a), self.number(b))
        if "string" in (x.kind, y.kind):
            return compare(self.text(a), self.text(b))
        n = self.number(a).isNotNull() & self.number(b).isNotNull()
        return F.when(n, compare(self.number(a), self.number(b))).otherwise(compare(self.text(a), self.text(b)))

    # --- functions ---------------------------------------------------------------------

    def call(self, e: Call) -> Value:
        n, a = e.name, e.args
        yes = lambda c: Value("boolean", c)
        if n == "||":
            return yes(self.truth(a[0]) | self.truth(a[1]))
        if n == "&&":
            return yes(self.truth(a[0]) & self.truth(a[1]))
        if n == "!":
            return yes(~self.truth(a[0]))
        if n == "=":
            return yes(self.equal(*a))
        if n == "!=":
            return yes(~self.equal(*a))
        if n in ("<", ">", "<=", ">="):
            return yes(self.less(*a, n))
        if n == "IN":
            return yes(reduce(lambda x, y: x | y, [self.equal(a[0], b) for b in a[1:]], F.lit(False)))
        if n in ("+", "-", "*", "/"):
            x, y = self.number(a[0]), self.number(a[1])
            whole = n != "/" and all(self.value(v).kind == "whole" for v in a)
            return Value("whole" if whole else "number", {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[n])
        if n == "NEG":
            return Value(self.value(a[0]).kind if self.value(a[0]).kind == "whole" else "number", -self.number(a[0]))
        if n == "BOUND":
            return yes(self.variable(a[0].name).isNotNull())
        if n == "COALESCE":
            kinds = [self.value(x) for x in a]
            if all(v.kind == "string" for v in kinds):
                return Value("string", F.coalesce(*[v.col for v in kinds]))
            return Value("term", F.coalesce(*[self.term(x) for x in a]))
        if n == "IF":
            t = self.truth(a[0])
            return Value("term", F.when(t, self.term(a[1])).when(~t, self.term(a[2])))
        if n in ("STR", "URI", "IRI"):
            if n == "STR":
                t = self.value(a[0])
                return Value("string", F.when(t.col["k"] != "b", t.col["v"]) if t.kind == "term" else self.string(a[0]))
            return Value("term", F.struct(F.lit("i").alias("k"), self.string(a[0]).alias("v"), F.lit("").alias("d"), F.lit("").alias("g")))
        if n == "LANG":
            return Value("string", F.when(self.term(a[0])["k"] == "l", self.term(a[0])["g"]))
        if n == "LANGMATCHES":
            tag, want = F.lower(self.text(a[0])), F.lower(self.text(a[1]))
            return yes(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))
        if n == "DATATYPE":
            t = self.term(a[0])
            kind = F.when(t["g"] != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(t["d"] == "", F.lit(XSD + "string")).otherwise(t["d"])
            return Value("term", F.when(t["k"] == "l", F.struct(F.lit("i").alias("k"), kind.alias("v"), F.lit("").alias("d"), F.lit("").alias("g"))))
        if n in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            return yes(self.term(a[0])["k"] == {"ISIRI": "i", "ISURI": "i", "ISBLANK": "b", "ISLITERAL": "l"}[n])
        if n == "ISNUMERIC":
            return yes(self.term(a[0])["d"].isin(NUMERIC) & self.term(a[0])["v"].try_cast("double").isNotNull())
        if n == "SAMETERM":
            return yes(self.term(a[0]) == self.term(a[1]))
        tests = {"CONTAINS": "contains", "STRSTARTS": "startswith", "STRENDS": "endswith"}
        if n in tests:
            return yes(getattr(self.text(a[0]), tests[n])(self.text(a[1])))
        if n == "REGEX":
            return yes(F.rlike(self.text(a[0]), self._pattern(a[1], a[2:3])))
        if n == "REPLACE":
            return Value("string", F.regexp_replace(self.text(a[0]), self._pattern(a[1], a[3:4]), self.text(a[2])), self._lang(a[0]))
        if n == "STRLEN":
            return Value("whole", F.length(self.text(a[0])).cast("double"))
        if n == "SUBSTR":
            start = self.number(a[1]).cast("int")
            cut = F.substr(self.text(a[0]), start, self.number(a[2]).cast("int")) if len(a) > 2 else F.substr(self.text(a[0]), start)
            return Value("string", cut, self._lang(a[0]))
        if n in ("UCASE", "LCASE"):
            return Value("string", (F.upper if n == "UCASE" else F.lower)(self.text(a[0])), self._lang(a[0]))
        if n in ("STRBEFORE", "STRAFTER"):
            text, mark = self.text(a[0]), self.text(a[1])
            place = F.position(mark, text)
            got = F.substr(text, F.lit(1), place - 1) if n == "STRBEFORE" else F.substr(text, place + F.length(mark))
            return Value("string", F.when(place == 0, F.lit("")).otherwise(got))
        if n == "CONCAT":
            return Value("string", F.concat(*[self.text(x) for x in a]) if a else F.lit(""))
        if n == "ENCODE_FOR_URI":
            return Value("string", F.replace(F.replace(F.url_encode(self.text(a[0])), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
        if n in ("ABS", "CEIL", "FLOOR", "ROUND"):
            x = self.number(a[0])
            made = {"ABS": F.abs(x), "CEIL": F.ceil(x), "FLOOR": F.floor(x), "ROUND": F.floor(x + 0.5)}[n].cast("double")
            return Value("number" if n == "ABS" and self.value(a[0]).kind != "whole" else "whole", made)
        if n == "RAND":
            return Value("number", F.rand())
        if n in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
            raw = self.text(a[0]).cast("binary")
            return Value("string", F.md5(raw) if n == "MD5" else F.sha1(raw) if n == "SHA1" else F.sha2(raw, int(n[3:])))
        if n in ("UUID", "STRUUID"):
            made = F.uuid()
            return Value("string", made) if n == "STRUUID" else Value("term", F.struct(F.lit("i").alias("k"), F.concat(F.lit("urn:uuid:"), made).alias("v"), F.lit("").alias("d"), F.lit("").alias("g")))
        if n == "NOW":
            return Value("term", _literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), XSD + "dateTime"))
        dates = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}
        if n in dates:
            return Value("whole", dates[n](F.try_to_timestamp(F.replace(self.string(a[0]), F.lit("T"), F.lit(" ")))).cast("double"))
        if n in ("TZ", "TIMEZONE"):
            return Value("string", F.regexp_extract(self.string(a[0]), r"(Z|[+-]\d\d:\d\d)$", 1))
        if n in ("STRDT", "STRLANG"):
            text, tag = self.text(a[0]), self.string(a[1])
            d, g = (tag, F.lit("")) if n == "STRDT" else (F.lit(""), F.lower(tag))
            return Value("term", F.struct(F.lit("l").alias("k"), text.alias("v"), F.when(d == XSD + "string", F.lit("")).otherwise(d).alias("d"), g.alias("g")))
        if n == "CAST":
            return self.cast(a[0].value, a[1])
        raise SparqlError(f"unknown function {n}")

    def cast(self, kind: str, e) -> Value:
        text = self.string(e)
        if kind in WHOLE:
            return Value("whole", F.floor(text.try_cast("double")).cast("double"))
        if kind in NUMERIC:
            return Value("number", text.try_cast("double"))
        if kind == XSD + "boolean":
            return Value("boolean", F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False))
        if kind == XSD + "string":
            return Value("string", text)
        return Value("term", _literal(text, kind))

    def _lang(self, e) -> Column | None:
        v = self.value(e)
        return v.col["g"] if v.kind == "term" else v.lang

    def _pattern(self, e, flags) -> Column:
        if flags and not isinstance(flags[0], Lit):
            raise SparqlError("the flags of an expression are a literal")
        marks = "".join(c for c in (flags[0].value if flags else "") if c in "imsx")
        return F.concat(F.lit(f"(?{marks})"), self.text(e)) if marks else self.text(e)

    # --- aggregates ----------------------------------------------------------------------

    def aggregate(self, a: Aggregate) -> Column:
        if a.name == "COUNT":
            if a.arg is None:
                count = F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (f"v_{n}" for n in sorted(self.rel.names))]) if a.distinct else F.count("*")
            else:
                count = F.count_distinct(self.term(a.arg)) if a.distinct else F.count(self.term(a.arg))
            return _literal(count.cast("string"), XSD + "integer")
        if a.name in ("SUM", "AVG"):
            x = self.number(a.arg)
            made = (F.sum_distinct(x) if a.distinct else F.sum(x)) if a.name == "SUM" else (F.avg(x) if not a.distinct else F.try_divide(F.sum_distinct(x), F.count_distinct(x)))
            return _literal(_number_text(F.coalesce(made, F.lit(0.0))), XSD + "decimal")
        if a.name in ("MIN", "MAX"):
            rank, number, text = self.order(a.arg)
            key = F.when(rank > 0, F.struct(rank, number, text))
            return (F.min_by if a.name == "MIN" else F.max_by)(self.term(a.arg), key)
        if a.name == "SAMPLE":
            return F.min_by(self.term(a.arg), self.string(a.arg))  # any will do; the least is the same in every run
        text = self.string(a.arg)
        made = F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text))
        return _literal(F.array_join(made, a.separator))

"""From the syntax tree to DataFrame plans.

A solution is a row with one struct column for each variable: (k, v, d, g), the
kind of a term (i, b or l), its text, datatype and language. ``certain`` names
the variables bound in every row: joins on those are plain equi-joins, others
get the compatibility condition. Patterns over a fact's node read the fact
table; constant predicates read the table that holds them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.lineage import cut
from lattica.plans.dataset import Dataset
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import LABEL, TYPE
from lattica.plans.sparql.expressions import Scope, has_aggregate
from lattica.plans.sparql.syntax import Aggregate, Exists, Iri, Lit, Path, Query, SparqlError, Var

TERM = "struct<k: string, v: string, d: string, g: string>"

#: Rows of a sub-SELECT that joins broadcast.
FEW = 1_000

#: The variable that holds the graph inside GRAPH with a variable; no query can name it.
GRAPH = "#graph"


@dataclass
class Rel:
    df: DataFrame
    certain: set[str] = field(default_factory=set)
    maybe: set[str] = field(default_factory=set)
    #: Whether a LIMIT keeps it to ``FEW`` rows at most.
    few: bool = False

    @property
    def names(self) -> set[str]:
        return self.certain | self.maybe


def col(name: str) -> str:
    return f"v_{name}"


def term(value: Column, kind: Column | None = None, datatype: Column | None = None, lang: Column | None = None) -> Column:
    kind = F.when(value.startswith("_:"), F.lit("b")).otherwise(F.lit("i")) if kind is None else kind
    empty = F.lit("")
    return F.struct(kind.alias("k"), value.alias("v"), F.coalesce(datatype, empty).alias("d") if datatype is not None else empty.alias("d"), F.coalesce(lang, empty).alias("g") if lang is not None else empty.alias("g"))


def constant(t) -> Column:
    if isinstance(t, Iri):
        return term(F.lit(t.value), F.lit("i"))
    return term(F.lit(t.value), F.lit("l"), F.lit(t.datatype), F.lit(t.lang))


def _kind(column: str) -> Column:
    return F.when(F.col(column) == "literal", "l").when(F.col(column) == "bnode", "b").otherwise("i")


def doubled(step: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(s, o), within equal keys, of all pairs with one or more steps between them.

    After k rounds all pairs at a distance of up to 2^k are known, with their
    distance. A pair at up to twice that is a known pair followed by one at 2^k
    exactly, so a round joins what is known with the pairs at its greatest
    distance, and rounds grow with the logarithm of the longest way. Cycles have
    no longer shortest ways, so they end too. Each pair is written once."""
    reach, known = 1, [cut(step.select(*keys, "s", "o").distinct().withColumn("d", F.lit(1)))]
    last = known[0]
    while not last.isEmpty():
        seen = reduce(DataFrame.unionByName, known)
        ahead = _ahead(last, keys)
        met = seen.join(ahead, _on(keys)).groupBy(*keys, "s", F.col("_o").alias("o")).agg((F.min("d") + reach).alias("d"))
        found = cut(met.join(seen.select(*keys, "s", "o"), [*keys, "s", "o"], "left_anti"))
        reach *= 2
        known.append(found)
        last = found.where(F.col("d") == reach)
    return reduce(DataFrame.unionByName, known).select(*keys, "s", "o")


class Compiler:
    """Patterns over one graph, or over the named graphs side by side if the tables
    have a graph column: each scan then binds GRAPH, so that joins meet within a
    graph."""

    def __init__(self, kg: KnowledgeGraph, dataset: Dataset | None = None):
        self.kg, self.v, self.dataset, self.keys = kg, kg.vocabulary, dataset, kg.keys
        self.fact_parts = {self.v("relationType"): "rel_type", self.v("sourceEntity"): "source", self.v("targetEntity"): "target"}

    # --- scans ---------------------------------------------------------------

    def edges(self, predicate: str) -> DataFrame:
        """(s, o) terms of a constant predicate."""
        kg = self.kg
        if predicate == LABEL:
            stated = kg.labels.select(*self.keys, term(F.col("node")).alias("s"), term(F.col("label"), F.lit("l"), None, F.col("lang")).alias("o"))
            return stated.unionByName(self._others(predicate))
        if predicate in self.fact_parts:
            part = self.fact_parts[predicate]
            kind = _kind("target_kind") if part == "target" else None
            return kg.facts.select(*self.keys, term(F.col("fact_id")).alias("s"), term(F.col(part), kind).alias("o")).distinct().unionByName(self._others(predicate))
        if predicate == TYPE:
            facts = kg.facts.select(*self.keys, term(F.col("fact_id")).alias("s"), term(F.lit(self.v("Relation"))).alias("o")).distinct()
            known = kg.types.where(F.col("cls") != self.v("Relation")).select(*self.keys, term(F.col("node")).alias("s"), term(F.col("cls")).alias("o")).unionByName(facts)
            return known.unionByName(self._others(TYPE)) if kg.loose else known
        return self._others(predicate)

    def _others(self, predicate: str) -> DataFrame:
        return self.kg.others.where(F.col("p") == predicate).select(*self.keys, term(F.col("s"), _kind("s_kind")).alias("s"), term(F.col("o"), _kind("o_kind"), F.col("o_datatype"), F.col("o_lang")).alias("o"))

    def any_edge(self) -> DataFrame:
        t = self.kg.triples()
        return t.select(*self.keys, term(F.col("s"), _kind("s_kind")).alias("s"), term(F.col("p"), F.lit("i")).alias("p"), term(F.col("o"), _kind("o_kind"), F.col("o_datatype"), F.col("o_lang")).alias("o"))

    def bound(self, df: DataFrame, columns: dict[str, object]) -> Rel:
        """Constants become filters, variables columns (equal if repeated)."""
        names: dict[str, str] = {}
        for c, t in columns.items():
            if not isinstance(t, Var):
                df = df.where(F.col(c) == constant(t))
            elif t.name in names:
                df = df.where(F.col(c) == F.col(names[t.name]))
            else:
                names[t.name] = c
        out = [F.col(c).alias(col(n)) for n, c in names.items()]
        if self.keys:
            out.append(term(F.col("graph"), F.lit("i")).alias(col(GRAPH)))
            names[GRAPH] = "graph"
        return Rel(df.select(*out), set(names))

    def triple(self, s, p, o) -> Rel:
        if isinstance(p, Var):
            return self.bound(self.any_edge(), {"s": s, "p": p, "o": o})
        if p.op == "iri":
            if p.args[0] == TYPE and isinstance(o, Iri) and o.value != self.v("Relation"):
                rows = self.kg.types.where(F.col("cls") == o.value).select(*self.keys, term(F.col("node")).alias("s"))
                return self.bound(rows, {"s": s})
            return self.bound(self.edges(p.args[0]), {"s": s, "o": o})
        return self.bound(self.path(p, s, o).distinct() if p.op in ("star", "plus", "opt") else self.path(p, s, o), {"s": s, "o": o})

    # --- property paths --------------------------------------------------------

    def path(self, p: Path, s, o) -> DataFrame:
        if p.op == "iri":
            return self.edges(p.args[0])
        if p.op == "inv":
            return self.path(p.args[0], o, s).select(*self.keys, F.col("o").alias("s"), F.col("s").alias("o"))
        if p.op == "alt":
            return reduce(DataFrame.unionByName, [self.path(a, s, o) for a in p.args])
        if p.op == "seq":
            steps = [self.path(a, Var("_"), Var("_")) for a in p.args]
            return reduce(lambda a, b: _follow(a, b, self.keys), steps)
        if p.op == "neg":
            ways = []
            for back in (False, True):
                names = [i for i, b in p.args if b is back]
                if names or not back:
                    rows = self.any_edge().where(~F.col("p.v").isin(names)) if names else self.any_edge()
                    if not names and any(b for _, b in p.args):
                        continue
                    ways.append(rows.select(*self.keys, F.col("o").alias("s"), F.col("s").alias("o")) if back else rows.select(*self.keys, "s", "o"))
            return reduce(DataFrame.unionByName, ways)
        step = self.path(p.args[0], Var("_"), Var("_")).distinct()
        if p.op == "opt":
            return step.unionByName(self.identity(s, o)).distinct()
        found = self.closure(step, s, o)
        return found if p.op == "plus" else found.unionByName(self.identity(s, o)).distinct()

    def identity(self, s, o) -> DataFrame:
        """A term is at length zero from itself: the given ones, or all nodes."""
        given = [t for t in (s, o) if not isinstance(t, Var)]
        if given:
            one = self.dataset.names() if self.keys else self.kg.spark.range(1)
            return reduce(DataFrame.unionByName, [one.select(*self.keys, constant(t).alias("s"), constant(t).alias("o")) for t in given])
        edges = self.any_edge()
        nodes = edges.select(*self.keys, "s").unionByName(edges.select(*self.keys, F.col("o").alias("s"))).distinct()
        return nodes.select(*self.keys, "s", F.col("s").alias("o"))

    def closure(self, step: DataFrame, s, o) -> DataFrame:
        """One or more steps: the frontier grows until it finds no new pair, so
        cycles end. From a given end only what it reaches is visited; between
        two variables the steps double."""
        if isinstance(s, Var) and isinstance(o, Var):
            return doubled(step, self.keys)
        backward = isinstance(s, Var) and not isinstance(o, Var)
        if backward:
            step = step.select(*self.keys, F.col("o").alias("s"), F.col("s").alias("o"))
        start = o if backward else s
        step = cut(step)
        frontier = cut(step.where(F.col("s") == constant(start)))
        found = [frontier]
        while not frontier.isEmpty():
            seen = reduce(DataFrame.unionByName, found)
            if len(found) == 16:  # so that the plan stays small and each pair is written twice at most a 16 rounds
                found = [seen := cut(seen)]
            frontier = cut(_follow(frontier, step, self.keys).distinct().join(seen, [*self.keys, "s", "o"], "left_anti"))
            found.append(frontier)
        seen = reduce(DataFrame.unionByName, found)
        return seen.select(*self.keys, F.col("o").alias("s"), F.col("s").alias("o")) if backward else seen

    # --- patterns ----------------------------------------------------------------

    def bgp(self, triples: list) -> list[Rel]:
        """The scans of a basic pattern; three parts of a fact are one scan."""
        out, rest = [], list(triples)
        by_subject: dict = {}
        for t in triples:
            by_subject.setdefault(t[0], []).append(t)
        for subject, own in by_subject.items():
            parts = {}
            for t in own:
                if isinstance(t[1], Path) and t[1].op == "iri" and t[1].args[0] in self.fact_parts:
                    parts.setdefault(self.fact_parts[t[1].args[0]], t)
            classes = [t for t in own if isinstance(t[1], Path) and t[1].args == (TYPE,) and t[2] == Iri(self.v("Relation"))]
            if len(parts) == 3 and (classes or not self.kg.loose):
                used = list(parts.values()) + classes
                rest = [t for t in rest if not any(t is u for u in used)]
                facts = self.kg.facts
                if isinstance(parts["rel_type"][2], Iri):
                    facts = facts.where(F.col("rel_type") == parts["rel_type"][2].value)  # prunes partitions
                rows = facts.select(*self.keys, term(F.col("fact_id")).alias("s"), term(F.col("rel_type")).alias("r"), term(F.col("source")).alias("a"), term(F.col("target"), _kind("target_kind")).alias("b"))
                out.append(self.bound(rows, {"s": subject, "r": parts["rel_type"][2], "a": parts["source"][2], "b": parts["target"][2]}))
        return out + [self.triple(*t) for t in rest]

    def group(self, elements: list, few: tuple[Rel, ...] = ()) -> Rel:
        """``few`` are small parts that the group is joined with. Scans are met with
        them and with its own first, so that arms of a union are not worked out for
        all nodes."""
        current, pending, filters = None, [], []

        def settle() -> Rel:
            nonlocal current, pending
            parts = ([current] if current is not None else []) + pending
            current, pending = (_join_all(parts) if parts else Rel(self.kg.spark.range(1).select())), []
            return current

        for e in elements:
            kind = e[0]
            if kind == "bgp":
                pending += [_among(r, few) for r in self.bgp(e[1])]
            elif kind == "group":
                pending.append(self.group(e[1], few))
                few += tuple(r for r in pending[-1:] if r.few)
            elif kind == "sub":
                if self.keys:
                    raise SparqlError("a sub-SELECT inside GRAPH with a variable is not supported")
                pending.append(self.query(e[1]))
                few += tuple(r for r in pending[-1:] if r.few)
            elif kind == "graph":
                pending += self.in_graph(e[1], e[2])
            elif kind == "union":
                pending.append(_union([self.group(a, few) for a in e[1]]))
            elif kind == "values":
                pending.append(self.values(e[1], e[2]))
            elif kind == "filter":
                filters.append(e[1])
            elif kind == "optional":
                left = settle()
                inner = [x for x in e[1] if x[0] != "filter"]
                current = _left_join(left, self.group(inner), [x[1] for x in e[1] if x[0] == "filter"], self)
            elif kind == "minus":
                left, right = settle(), self.group(e[1])
                shared = left.names & right.names
                if shared - {GRAPH}:
                    current = Rel(_semi(left, right, shared, "left_anti", at_least_one=True), left.certain, left.maybe)
            elif kind == "bind":
                left = settle()
                if e[2] in left.names:
                    raise SparqlError(f"?{e[2]} is already bound")
                value = Scope(left, self).term(e[1])
                current = Rel(left.df.withColumn(col(e[2]), value), left.certain, left.maybe | {e[2]})
        out = settle()
        for f in filters:
            out = self.filter(out, f)
        return out

    def in_graph(self, name: Var | Iri, elements: list) -> list[Rel]:
        """A group over one named graph, or over each of them, as parts to be
        joined: the scans of a basic pattern may be linked by what stands outside
        alone, and are a product of the graph with itself without it. What is no
        named graph has no solution. The variable is bound beside the group's own
        solutions, so a filter inside the group does not see it."""
        data = self.dataset
        if data is None:
            raise SparqlError("GRAPH needs a dataset of named graphs")
        names = data.names()
        if isinstance(name, Iri):
            parts = Compiler(data.one(name.value), data).parts(elements)
            if any(x[0] == "bgp" for x in elements):
                return parts  # what they matched is there
            return [Rel(_semi(r, Rel(names.where(F.col("graph") == name.value)), set(), "left_semi"), r.certain, r.maybe) for r in parts]
        return [self.named_by(name.name, r) for r in Compiler(data.named, data).parts(elements)]

    def named_by(self, n: str, inner: Rel) -> Rel:
        """Solutions inside any named graph with the graph as a variable."""
        if GRAPH not in inner.certain:
            inner = _join(inner, Rel(self.dataset.names().select(term(F.col("graph"), F.lit("i")).alias(col(GRAPH))), {GRAPH}))
        own, graph = F.col(col(n)), F.col(col(GRAPH))
        df = inner.df.where(own.isNull() | (own == graph)) if n in inner.names else inner.df
        return Rel(df.withColumn(col(n), graph).drop(col(GRAPH)), (inner.certain - {GRAPH}) | {n}, inner.maybe - {n})

    def parts(self, elements: list) -> list[Rel]:
        """The scans of a group that is basic patterns alone, else the group."""
        if elements and all(x[0] == "bgp" for x in elements):
            return [r for x in elements for r in self.bgp(x[1])] or [self.group(elements)]
        return [self.group(elements)]

    def filter(self, rel: Rel, e) -> Rel:
        if isinstance(e, Exists):
            return self.exists(rel, e)
        if getattr(e, "name", None) == "&&":
            return self.filter(self.filter(rel, e.args[0]), e.args[1])
        if getattr(e, "name", None) == "!" and isinstance(e.args[0], Exists):
            return self.filter(rel, Exists(e.args[0].group, not e.args[0].negated))
        return Rel(rel.df.where(Scope(rel, self).truth(e)), rel.certain, rel.maybe)

    def exists(self, rel: Rel, e: Exists) -> Rel:
        """A semi-join with the inner pattern. Its filters that name variables
        of the outer pattern alone, not its own, become part of the condition;
        equalities among them become keys of the join."""
        how = "left_anti" if e.negated else "left_semi"
        body, filters = [x for x in e.group if x[0] != "filter"], [x[1] for x in e.group if x[0] == "filter"]
        inner = self.group(body)
        outer = rel.names - inner.names
        if hidden := outer & _in_expressions(body):
            raise SparqlError(f"?{min(hidden)} of the outer pattern is used inside a part of EXISTS; only its own filters may")
        lifted = [f for f in filters if outer & _variables(f)]
        if any(_has_exists(f) for f in lifted):
            raise SparqlError("an EXISTS inside EXISTS cannot use variables of the outer pattern")
        for f in filters:
            if f not in lifted:
                inner = self.filter(inner, f)
        if not lifted:
            return Rel(_semi(rel, inner, rel.names & inner.names, how), rel.certain, rel.maybe)
        df, on, values = _matched(rel, inner)
        certain = rel.certain | inner.certain
        columns = {n: values.get(n, rel.df[col(n)]) for n in rel.names} | {n: df[col(n)] for n in inner.names - rel.names}
        scope = Scope(Rel(rel.df, certain, (rel.names | inner.names) - certain), self, columns)
        keyed = on is not None and all(n in rel.certain and n in inner.certain for n in rel.names & inner.names)
        mine = (rel.names - inner.names) | (rel.names & rel.certain)
        for f in [c for f in lifted for c in _conjuncts(f)]:
            on = scope.truth(f) if on is None else on & scope.truth(f)
            if getattr(f, "name", None) == "=":
                # Equal values share a key, which Spark can deal both sides by.
                for a, b in (f.args, f.args[::-1]):
                    if _variables(a) and _variables(b) and _variables(a) <= mine and _variables(b) <= inner.names - rel.names:
                        x, y = scope.key(a), scope.key(b)
                        if x is not None and y is not None:
                            on, keyed = on & (x == y), True
        if not keyed and df.limit(MOST_UNKEYED + 1).count() > MOST_UNKEYED:
            # Without a key Spark sends the inner side to all tasks.
            raise SparqlError(f"EXISTS compares more than {MOST_UNKEYED} inner rows without an equality; state one")
        return Rel(rel.df.join(df, on, how), rel.certain, rel.maybe)

    def values(self, names: list[str], rows: list) -> Rel:
        schema = ", ".join(f"{col(n)} {TERM}" for n in names)
        made = [tuple(None if t is None else ("i", t.value, "", "") if isinstance(t, Iri) else ("l", t.value, t.datatype, t.lang) for t in r) for r in rows]
        certain = {n for i, n in enumerate(names) if all(r[i] is not None for r in made)}
        return Rel(self.kg.spark.createDataFrame(made, schema), certain, set(names) - certain)

    # --- queries -------------------------------------------------------------------

    def query(self, q: Query) -> Rel:
        rel = self.group(q.where)
        if q.values:
            rel = _join(rel, self.values(*q.values))
        grouped = bool(q.group) or any(has_aggregate(e) for e, _ in q.items or []) or any(map(has_aggregate, q.having))
        if grouped:
            rel, items = self.aggregate(rel, q)
        else:
            items = q.items
            if items is None:
                names = [n for n in _in_order(q.where) if n in rel.names and not n.startswith("_blank")]
                items = [(Var(n), n) for n in names]
        scope = Scope(rel, self)
        certain = {n for e, n in items if isinstance(e, Var) and e.name in rel.certain}
        made = rel.df
        # All variables stay for ORDER BY; only the named ones go on.
        for e, n in items:
            if e != Var(n):
                made = made.withColumn(col(n), scope.term(e))
                scope = Scope(Rel(made, rel.certain, rel.maybe | {n}), self)
                rel = scope.rel
        none = F.lit(None).cast(TERM)
        keys = [(scope.order(e), up) for e, up in q.order]
        shown = [(F.col(col(n)) if n in rel.names else none).alias(col(n)) for _, n in items]
        sort = [k for k, _ in keys]
        ordered = made.select(*shown, *[k.alias(f"o_{i}_{j}") for i, parts in enumerate(sort) for j, k in enumerate(parts)])
        if q.distinct:
            # SPARQL orders before it removes duplicates: the first place counts.
            ways = [(F.min if up else F.max, f"o_{i}_{j}") for i, (parts, up) in enumerate(keys) for j in range(len(parts))]
            ordered = ordered.groupBy(*[col(n) for _, n in items]).agg(*[f(c).alias(c) for f, c in ways]) if ways else ordered.distinct()
        if q.limit is not None or q.offset or q.order:
            by = [F.col(f"o_{i}_{j}").asc_nulls_first() if up else F.col(f"o_{i}_{j}").desc_nulls_last() for i, (parts, up) in enumerate(keys) for j in range(len(parts))]
            # Ties, and limits without an order, go by all columns.
            by += [F.coalesce(F.col(f"{col(n)}.v"), F.lit("")) for _, n in items] + [F.col(col(n)) for _, n in items]
            ordered = ordered.orderBy(*by)
        if q.offset:
            ordered = ordered.offset(q.offset)
        if q.limit is not None:
            ordered = ordered.limit(q.limit)
        names = [n for _, n in items]
        return Rel(ordered.select(*[col(n) for n in names]), certain & set(names), set(names) - certain, q.limit is not None and q.limit <= FEW)

    def aggregate(self, rel: Rel, q: Query) -> tuple[Rel, list]:
        if q.items is None:
            raise SparqlError("SELECT * cannot be grouped")
        scope, keys = Scope(rel, self), []
        for i, (e, n) in enumerate(q.group):
            keys.append((scope.term(e), n or f"_key{i}"))
        df = rel.df.select(*[c.alias(f"k_{n}") for c, n in keys], "*")
        inner, found = Scope(Rel(df, rel.certain, rel.maybe), self), {}

        def lifted(e):
            """Aggregates become variables of the grouped table."""
            if isinstance(e, Aggregate):
                name = found.setdefault(e, f"_agg{len(found)}")
                return Var(name)
            if hasattr(e, "args"):
                return type(e)(e.name, tuple(lifted(a) for a in e.args))
            return e

        items = [(lifted(e), n) for e, n in q.items]
        having = [lifted(h) for h in q.having]
        made = [inner.aggregate(a).alias(col(n)) for a, n in found.items()] or [F.count("*").alias("_n")]
        out = df.groupBy(*[f"k_{n}" for _, n in keys]).agg(*made)
        out = out.select(*[F.col(f"k_{n}").alias(col(n)) for _, n in keys], *[col(n) for n in found.values()])
        grouped = Rel(out, {n for c, n in keys if n in rel.certain}, {n for _, n in keys if n not in rel.certain} | set(found.values()))
        for h in having:
            grouped = self.filter(grouped, h)
        return grouped, items


# --- variables of expressions -------------------------------------------------------------


#: Rows of an inner pattern that may be compared with all outer rows.
MOST_UNKEYED = 100_000


def _conjuncts(e) -> list:
    return _conjuncts(e.args[0]) + _conjuncts(e.args[1]) if getattr(e, "name", None) == "&&" else [e]


def _variables(e) -> set[str]:
    """The variables that an expression names, those inside EXISTS as well."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Exists):
        return _mentioned(e.group)
    if isinstance(e, Aggregate):
        return _variables(e.arg)
    if isinstance(e, (list, tuple)):
        return set().union(*map(_variables, e))
    return _variables(e.args) if hasattr(e, "args") and not isinstance(e, Path) else set()


def _mentioned(elements: list) -> set[str]:
    return set(_in_order(elements)) | _in_expressions(elements) | {v for x in elements if x[0] == "filter" for v in _variables(x[1])}


def _in_expressions(elements: list) -> set[str]:
    """The variables that BIND, and filters of nested groups, name."""
    found: set[str] = set()
    for x in elements:
        if x[0] == "bind":
            found |= _variables(x[1])
        elif x[0] in ("group", "optional", "minus", "union"):
            for arm in x[1] if x[0] == "union" else [x[1]]:
                found |= _in_expressions(arm) | {v for y in arm if y[0] == "filter" for v in _variables(y[1])}
        elif x[0] == "graph":
            found |= _in_expressions(x[2]) | {v for y in x[2] if y[0] == "filter" for v in _variables(y[1])}
    return found


def _has_exists(e) -> bool:
    if isinstance(e, Exists):
        return True
    return any(map(_has_exists, e.args)) if hasattr(e, "args") and not isinstance(e, Path) else False


# --- joins of solutions ------------------------------------------------------------------


def _ahead(steps: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return steps.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("s").alias("_m"), F.col("o").alias("_o"))


def _on(keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys], F.col("o") == F.col("_m"))


def _follow(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return a.join(_ahead(b, keys), _on(keys)).select(*keys, "s", F.col("_o").alias("o"))


def _matched(left: Rel, right: Rel) -> tuple[DataFrame, Column | None, dict[str, Column]]:
    """The right side with its shared columns renamed, the condition, and the
    value of each shared variable."""
    shared = sorted(left.names & right.names)
    df = right.df
    for n in shared:
        df = df.withColumnRenamed(col(n), f"r_{n}")
    parts, values = [], {}
    for n in shared:
        a, b = F.col(col(n)), F.col(f"r_{n}")  # by name: both sides may hold the same small part
        same = a == b
        if n not in left.certain:
            same = a.isNull() | same
        if n not in right.certain:
            same = b.isNull() | same
        parts.append(same)
        values[n] = a if n in left.certain else F.coalesce(a, b)
    return df, (reduce(lambda x, y: x & y, parts) if parts else None), values


def _join(left: Rel, right: Rel) -> Rel:
    df, on, values = _matched(left, right)
    mine, other = (F.broadcast(d) if r.few else d for r, d in ((left, left.df), (right, df)))
    joined = mine.join(other, on) if on is not None else mine.crossJoin(other)
    out = joined.select(
        *[(values[n] if n in values else F.col(col(n))).alias(col(n)) for n in sorted(left.names)], *[col(n) for n in sorted(right.names - left.names)]
    )
    certain = left.certain | right.certain
    return Rel(out, certain, (left.maybe | right.maybe) - certain)


def _among(rel: Rel, few: tuple[Rel, ...]) -> Rel:
    """What can join the small parts."""
    for f in few:
        if shared := rel.certain & f.certain:
            df, on, _ = _matched(rel, Rel(f.df.select(*[col(n) for n in sorted(shared)]), shared))
            rel = Rel(rel.df.join(F.broadcast(df), on, "left_semi"), rel.certain, rel.maybe)
    return rel


def _join_all(parts: list[Rel]) -> Rel:
    """Joins in an order that meets shared variables first, so that a product
    is made only where the pattern has two parts without a link."""
    current, rest = parts[0], parts[1:]
    while rest:
        pick = max(range(len(rest)), key=lambda i: (len(rest[i].certain & current.certain), len(rest[i].names & current.names), -i))
        current = _join(current, rest.pop(pick))
    return current


def _left_join(left: Rel, right: Rel, filters: list, compiler: Compiler) -> Rel:
    df, on, values = _matched(left, right)
    certain = left.certain | right.certain
    columns = {n: values.get(n, left.df[col(n)]) for n in left.names} | {n: df[col(n)] for n in right.names - left.names}
    scope = Scope(Rel(left.df, certain, (left.names | right.names) - certain), compiler, columns)
    for f in filters:
        on = scope.truth(f) if on is None else on & scope.truth(f)
    joined = left.df.join(df, on if on is not None else F.lit(True), "left")
    out = joined.select(*[columns[n].alias(col(n)) for n in sorted(left.names)], *[df[col(n)] for n in sorted(right.names - left.names)])
    return Rel(out, left.certain, (left.maybe | right.names) - left.certain)


def _semi(left: Rel, right: Rel, shared: set[str], how: str, at_least_one: bool = False) -> DataFrame:
    if not shared:
        return left.df.join(right.df.limit(1), F.lit(True), how)
    df, on, _ = _matched(left, Rel(right.df.select(*[col(n) for n in sorted(shared)]), right.certain & shared, right.maybe & shared))
    linked = shared - {GRAPH}
    if at_least_one and not (linked & left.certain & right.certain):
        on &= reduce(lambda x, y: x | y, [left.df[col(n)].isNotNull() & df[f"r_{n}"].isNotNull() for n in sorted(linked)])
    return left.df.join(df, on, how)


def _union(arms: list[Rel]) -> Rel:
    certain = reduce(set.intersection, [a.certain for a in arms])
    names = sorted(reduce(set.union, [a.names for a in arms]))
    none = F.lit(None).cast(TERM)
    same = [a.df.select(*[(F.col(col(n)) if n in a.names else none).alias(col(n)) for n in names]) for a in arms]
    return Rel(reduce(DataFrame.unionByName, same), certain, set(names) - certain)


def _in_order(elements: list) -> list[str]:
    """Variable names by first appearance."""
    seen: dict[str, None] = {}

    def walk(x):
        if isinstance(x, Var):
            seen.setdefault(x.name)
        elif isinstance(x, Query):
            if x.items is None:
                walk(x.where)
            for _, n in x.items or []:
                seen.setdefault(n)
        elif isinstance(x, (list, tuple)):
            if len(x) == 3 and x[0] == "bind":
                seen.setdefault(x[2])
            elif len(x) == 3 and x[0] == "values":
                for n in x[1]:
                    seen.setdefault(n)
            elif not (len(x) == 2 and x[0] in ("filter", "minus")):
                for y in x:
                    walk(y)

    walk(elements)
    return list(seen)


def compile_select(kg: KnowledgeGraph | Dataset, q: Query) -> DataFrame:
    data = kg if isinstance(kg, Dataset) else None
    if q.sources:
        if data is None:
            raise SparqlError("FROM needs a dataset of named graphs")
        data = data.restricted([i for i, named in q.sources if not named], [i for i, named in q.sources if named])
    rel = Compiler(data.default if data else kg, data).query(q)
    return rel.df.select(*[F.coalesce(F.col(f"{c}.v"), F.lit("")).alias(c.removeprefix("v_")) for c in rel.df.columns])

"""The queries of the knowledge-graph operators over the star graph, with the
DuckDB SQL that says the same. Nothing here belongs to the training-data
operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.lineage import folder
from lattica.operators import alignment, extraction, lookups, network, sameas
from lattica.plans import answers
from lattica.plans.dataset import QUADS, Dataset, named
from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import DEFAULT_NAMESPACE as V
from lattica.plans.model import LABEL, TRIPLES, XSD, Vocabulary
from lattica.plans.routing import route_questions
from lattica.plans.service import EMPTY, FALLBACK, answer_questions
from lattica.plans.sparql import select
from lattica.plans.sparql.texts import Texts
from lattica.sources.records import write_json
from lattica.sources.starkg import NODE, node, star_graph
from lattica.sources.turtle import read_nquads, read_ntriples, read_turtle, write_turtle

Query = Callable[[SparkSession, str], DataFrame]

#: Slots: ten persons at every scale; a hundred, above the candidate cap; one
#: by the reverse direction only; schools; and a parent with a child.
TEN = "Customer#00000001"
HUNDRED = "Customer#0000000"
REVERSE = "xx Customer#000000005 yy"
SCHOOL = "NATION_1"
PAIR = ("Customer#000000005", "Customer#000000010")

_FACT = "SELECT '{v}{rel}' AS rel_type, {s} AS source, {t} AS target FROM {rows}"


def _n(kind: str, key: str) -> str:
    return f"'{NODE}{kind}/' || ({key})::VARCHAR"


_SPANS = "(SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)"
_FACTS = " UNION ALL ".join(
    _FACT.format(v=V, rel=rel, s=s, t=t, rows=rows)
    for rel, s, t, rows in (
        ("hasCourtesyName", _n("customer", "c_custkey"), _n("segment", "c_mktsegment"), "customer"),
        ("hasArtName", _n("customer", "o_custkey"), _n("priority", "o_orderpriority"), "(SELECT DISTINCT o_custkey, o_orderpriority FROM orders)"),
        ("bornIn", _n("customer", "o_custkey"), _n("year", "year(first)"), _SPANS),
        ("diedIn", _n("customer", "o_custkey"), _n("year", "year(last)"), _SPANS),
        ("hasTeacher", _n("customer", "o_custkey"), _n("supplier", "l_suppkey"), "(SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"),
        ("fatherOf", _n("customer", "c_custkey // 2"), _n("customer", "c_custkey"), "customer WHERE c_custkey >= 1"),
        ("hasFriend", _n("customer", "c_custkey"), _n("customer", "friend"), "(SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS friend FROM customer) WHERE friend IS NOT NULL"),
        ("belongsToSchool", _n("customer", "c_custkey"), _n("nation", "c_nationkey"), "customer"),
        ("foundsSchool", _n("supplier", "s_suppkey"), _n("nation", "s_nationkey"), "supplier"),
    )
)
_LABELLED = ", ".join(f"('{r}')" for r in ("hasCourtesyName", "hasArtName", "bornIn", "diedIn", "hasTeacher", "fatherOf", "belongsToSchool", "foundsSchool"))
GRAPH_SQL = f"""
facts AS ({_FACTS}),
labels AS (
  SELECT {_n("customer", "c_custkey")} AS node, c_name AS label FROM customer
  UNION ALL SELECT {_n("supplier", "s_suppkey")}, s_name FROM supplier
  UNION ALL SELECT {_n("nation", "n_nationkey")}, n_name FROM nation
  UNION ALL SELECT DISTINCT {_n("segment", "c_mktsegment")}, c_mktsegment FROM customer
  UNION ALL SELECT DISTINCT {_n("priority", "o_orderpriority")}, o_orderpriority FROM orders
  UNION ALL SELECT DISTINCT {_n("year", "year(o_orderdate)")}, year(o_orderdate)::VARCHAR FROM orders WHERE year(o_orderdate) % 2 = 0
  UNION ALL SELECT '{V}' || r, r FROM (VALUES {_LABELLED}) t(r)
),
persons AS (
  SELECT {_n("customer", "c_custkey")} AS node, c_name AS label FROM customer
  UNION ALL SELECT {_n("supplier", "s_suppkey")}, s_name FROM supplier
),
literals AS (
  SELECT {_n("customer", "o_custkey")} AS node, '{V}bornIn' AS p, strftime(first, '%Y-%m') AS value FROM {_SPANS} WHERE o_custkey % 2 = 0
  UNION ALL SELECT {_n("customer", "o_custkey")}, '{V}diedIn', strftime(last, '%Y-%m') FROM {_SPANS} WHERE o_custkey % 2 = 0
)"""


def _either(label: str, text: str) -> str:
    return f"(contains({label}, '{text}') OR contains('{text}', {label}))"


def _people(text: str) -> str:
    return f"cand AS (SELECT DISTINCT node AS person, label FROM persons WHERE {_either('label', text)} ORDER BY 1, 2 LIMIT 30)"


def _sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([GRAPH_SQL, *ctes])} {body}"


def _shown(columns: str, limit: int, distinct: bool = True) -> tuple[str, str]:
    names = columns.split()
    return f"SELECT {'DISTINCT ' if distinct else ''}" + ", ".join(f"coalesce({n}, '') AS {n}" for n in names), f"ORDER BY {', '.join(str(i + 1) for i in range(len(names)))} LIMIT {limit}"


def _named_sql(text: str, rel: str, kind: str) -> str:
    head, tail = _shown(f"person label {kind}Node {kind}Label {kind}Name", 30)
    rows = f"SELECT c.person, c.label, f.target AS {kind}Node, l.label AS {kind}Label, coalesce(l.label, f.target) AS {kind}Name FROM cand c JOIN facts f ON f.source = c.person AND f.rel_type = '{V}{rel}' LEFT JOIN labels l ON l.node = f.target"
    return _sql(f"{head} FROM ({rows}) {tail}", _people(text))


def _simple_sql(text: str, rel: str, value: str, limit: int = 30) -> str:
    head, tail = _shown(f"person label {value} {value}Label", limit)
    rows = f"SELECT c.person, c.label, f.target AS {value}, coalesce(l.label, f.target) AS {value}Label FROM cand c JOIN facts f ON f.source = c.person AND f.rel_type = '{V}{rel}' LEFT JOIN labels l ON l.node = f.target"
    return _sql(f"{head} FROM ({rows}) {tail}", _people(text))


def _years_sql(rel: str, out: str) -> str:
    return (
        f"SELECT person, string_agg(DISTINCT item, ' / ' ORDER BY item) AS {out} FROM ("
        f"SELECT f.source AS person, coalesce(l.label, f.target) AS item FROM facts f LEFT JOIN labels l ON l.node = f.target WHERE f.rel_type = '{V}{rel}'"
        f" UNION ALL SELECT node, value FROM literals WHERE p = '{V}{rel}') GROUP BY person"
    )


def _birth_death_sql(people: str) -> str:
    head, tail = _shown("person label birthYear deathYear", 20, distinct=False)
    rows = f"SELECT c.person, c.label, b.birthYear, d.deathYear FROM cand c LEFT JOIN ({_years_sql('bornIn', 'birthYear')}) b USING (person) LEFT JOIN ({_years_sql('diedIn', 'deathYear')}) d USING (person)"
    return _sql(f"{head} FROM ({rows}) {tail}", people)


def _both_ends(where: str, forward: str, backward: str) -> str:
    return (
        f"ends AS (SELECT source AS person, target AS other, rel_type, '{forward}' AS tag FROM facts {where}"
        f" UNION ALL SELECT target, source, rel_type, '{backward}' FROM facts {where})"
    )


def _ends_sql(text: str, rel: str, other: str, tag: str | None, limit: int) -> str:
    columns = f"person label {other} {other}Label" + (f" {tag}" if tag else "")
    head, tail = _shown(columns, limit)
    rows = f"SELECT c.person, c.label, e.other AS {other}, coalesce(l.label, e.other) AS {other}Label, e.tag AS {tag or 'tag'} FROM cand c JOIN ends e USING (person) LEFT JOIN labels l ON l.node = e.other"
    return _sql(f"{head} FROM ({rows}) {tail}", _people(text), _both_ends(f"WHERE rel_type = '{V}{rel}'", lookups.CHILD, lookups.PARENT))


def _founder_sql(text: str) -> str:
    head, tail = _shown("founder founderLabel school schoolLabel", 20)
    rows = f"SELECT f.source AS founder, coalesce(l.label, f.source) AS founderLabel, s.school, s.schoolLabel FROM schools s JOIN facts f ON f.target = s.school AND f.rel_type = '{V}foundsSchool' LEFT JOIN labels l ON l.node = f.source"
    schools = f"schools AS (SELECT DISTINCT node AS school, label AS schoolLabel FROM labels WHERE {_either('label', text)} ORDER BY 1, 2 LIMIT 30)"
    return _sql(f"{head} FROM ({rows}) {tail}", schools)


def _pair_sql(first: str, second: str, limit: int, cap: str, distinct: bool) -> str:
    head, tail = _shown("sourceLabel targetLabel relation relationLabel direction", limit, distinct)
    side = lambda n, t: f"{n} AS (SELECT DISTINCT node, label FROM persons WHERE contains(label, '{t}') {cap})"
    read = lambda x, y, d: f"SELECT a.label AS sourceLabel, b.label AS targetLabel, f.rel_type AS relation, l.label AS relationLabel, '{d}' AS direction FROM facts f JOIN a ON a.node = f.{x} JOIN b ON b.node = f.{y} LEFT JOIN labels l ON l.node = f.rel_type"
    return _sql(f"{head} FROM ({read('source', 'target', lookups.FORWARD)} UNION ALL {read('target', 'source', lookups.BACKWARD)}) {tail}", side("a", first), side("b", second))


def _related_sql(text: str) -> str:
    head, tail = _shown("person label related relatedLabel relation relationLabel direction", 50)
    rows = "SELECT c.person, c.label, e.other AS related, p.label AS relatedLabel, e.rel_type AS relation, l.label AS relationLabel, e.tag AS direction FROM cand c JOIN ends e USING (person) JOIN persons p ON p.node = e.other LEFT JOIN labels l ON l.node = e.rel_type"
    return _sql(f"{head} FROM ({rows}) {tail}", _people(text), _both_ends("", lookups.OUTGOING, lookups.INCOMING))


def _template_sql(text: str, rel: str, kind: str) -> str:
    head, tail = _shown(f"person label {kind}Node {kind}Label", 20, distinct=False)
    return _sql(f"{head} FROM (SELECT p.node AS person, p.label, f.target AS {kind}Node, l.label AS {kind}Label FROM persons p JOIN facts f ON f.source = p.node AND f.rel_type = '{V}{rel}' LEFT JOIN labels l ON l.node = f.target WHERE contains(p.label, '{text}')) {tail}")


def _template_founder_sql(text: str) -> str:
    head, tail = _shown("founder founderLabel school schoolLabel", 20, distinct=False)
    return _sql(f"{head} FROM (SELECT f.source AS founder, a.label AS founderLabel, f.target AS school, b.label AS schoolLabel FROM facts f LEFT JOIN labels a ON a.node = f.source LEFT JOIN labels b ON b.node = f.target WHERE f.rel_type = '{V}foundsSchool' AND {_either('b.label', text)}) {tail}")


def _labels_sql(text: str) -> str:
    head, tail = _shown("person label", 20)
    return _sql(f"{head} FROM (SELECT node AS person, label FROM persons WHERE contains(label, '{text}')) {tail}")


def _on(function, *slots: str) -> Query:
    return lambda spark, sf_dir: function(star_graph(spark, sf_dir), *slots)


QUERIES: dict[str, Query] = {
    "person_labels": _on(lookups.person_labels, HUNDRED),
    "courtesy_name": _on(lookups.courtesy_name, TEN),
    "courtesy_name_capped": _on(lookups.courtesy_name, HUNDRED),
    "courtesy_name_reverse": _on(lookups.courtesy_name, REVERSE),
    "art_name": _on(lookups.art_name, TEN),
    "birth_death": _on(lookups.birth_death, TEN),
    "birth_death_capped": _on(lookups.birth_death, HUNDRED),
    "teacher_relations": _on(lookups.teacher_relations, TEN),
    "family_relations": _on(lookups.family_relations, TEN),
    "social_relations": _on(lookups.social_relations, TEN),
    "school_membership": _on(lookups.school_membership, TEN),
    "school_founder": _on(lookups.school_founder, SCHOOL),
    "pair_relations": _on(lookups.pair_relations, *PAIR),
    "pair_relations_reverse": _on(lookups.pair_relations, *PAIR[::-1]),
    "related_people": _on(lookups.related_people, TEN),
    "fs_courtesy": _on(lookups.template_courtesy_name, TEN),
    "fs_art": _on(lookups.template_art_name, TEN),
    "fs_birth_death": _on(lookups.template_birth_death, TEN),
    "fs_pair": _on(lookups.template_pair, *PAIR),
    "fs_founder": _on(lookups.template_founder, SCHOOL),
}

_TEMPLATE_PEOPLE = "cand AS (SELECT node AS person, label FROM persons WHERE contains(label, '%s'))"
ORACLE: dict[str, str] = {
    "person_labels": _labels_sql(HUNDRED),
    "courtesy_name": _named_sql(TEN, "hasCourtesyName", "courtesy"),
    "courtesy_name_capped": _named_sql(HUNDRED, "hasCourtesyName", "courtesy"),
    "courtesy_name_reverse": _named_sql(REVERSE, "hasCourtesyName", "courtesy"),
    "art_name": _named_sql(TEN, "hasArtName", "art"),
    "birth_death": _birth_death_sql(_people(TEN)),
    "birth_death_capped": _birth_death_sql(_people(HUNDRED)),
    "teacher_relations": _simple_sql(TEN, "hasTeacher", "teacher"),
    "family_relations": _ends_sql(TEN, "fatherOf", "relative", "relationType", 40),
    "social_relations": _ends_sql(TEN, "hasFriend", "friend", None, 30),
    "school_membership": _simple_sql(TEN, "belongsToSchool", "school"),
    "school_founder": _founder_sql(SCHOOL),
    "pair_relations": _pair_sql(*PAIR, 30, "ORDER BY 1, 2 LIMIT 20", True),
    "pair_relations_reverse": _pair_sql(*PAIR[::-1], 30, "ORDER BY 1, 2 LIMIT 20", True),
    "related_people": _related_sql(TEN),
    "fs_courtesy": _template_sql(TEN, "hasCourtesyName", "courtesy"),
    "fs_art": _template_sql(TEN, "hasArtName", "art"),
    "fs_birth_death": _birth_death_sql(_TEMPLATE_PEOPLE % TEN),
    "fs_pair": _pair_sql(*PAIR, 20, "", False),
    "fs_founder": _template_founder_sql(SCHOOL),
}


# --- SPARQL text -----------------------------------------------------------------

_TEXTS = Texts()
_HEAD = _TEXTS.v.header()
_P = _TEXTS.p


def _sparql(text: str) -> Query:
    return lambda spark, sf_dir: select(star_graph(spark, sf_dir), text)


#: The lookups from their texts have the lookups' SQL.
for _name, _slots in {
    "person_labels": (HUNDRED,), "courtesy_name": (TEN,), "art_name": (TEN,), "birth_death": (TEN,), "teacher_relations": (TEN,), "family_relations": (TEN,),
    "social_relations": (TEN,), "school_membership": (TEN,), "school_founder": (SCHOOL,), "pair_relations": PAIR, "related_people": (TEN,),
    "fs_courtesy": (TEN,), "fs_art": (TEN,), "fs_birth_death": (TEN,), "fs_pair": PAIR, "fs_founder": (SCHOOL,),
}.items():
    QUERIES[f"sparql_{_name}"] = _sparql(getattr(_TEXTS, _name)(*_slots))
    ORACLE[f"sparql_{_name}"] = ORACLE[_name]


def _ad_hoc(name: str, text: str, sql: str) -> None:
    QUERIES[name] = _sparql(f"{_HEAD}\n{text}")
    ORACLE[name] = _sql(sql)


_ad_hoc(
    "sparql_order_agg",
    f"SELECT ?type (COUNT(?f) AS ?n) (COUNT(DISTINCT ?t) AS ?targets) WHERE {{ ?f a {_P}:Relation ; {_P}:relationType ?type ; {_P}:sourceEntity ?s ; {_P}:targetEntity ?t }} GROUP BY ?type HAVING (COUNT(?f) > 120) ORDER BY DESC(?n) LIMIT 5",
    'SELECT rel_type AS "type", count(*)::VARCHAR AS n, count(DISTINCT target)::VARCHAR AS targets FROM facts GROUP BY 1 HAVING count(*) > 120 ORDER BY count(*) DESC, 1 LIMIT 5',
)
_ad_hoc(
    "sparql_minus",
    f"SELECT ?p ?l WHERE {{ ?p a {_P}:Person ; rdfs:label ?l MINUS {{ ?f {_P}:relationType {_P}:hasFriend ; {_P}:sourceEntity ?p ; {_P}:targetEntity ?q }} }}",
    f"SELECT node AS p, label AS l FROM persons WHERE node NOT IN (SELECT source FROM facts WHERE rel_type = '{V}hasFriend')",
)
_ad_hoc(
    "sparql_exists",
    f"SELECT ?p WHERE {{ ?p a {_P}:Person FILTER EXISTS {{ ?f {_P}:relationType {_P}:foundsSchool ; {_P}:sourceEntity ?p ; {_P}:targetEntity ?s }} FILTER NOT EXISTS {{ ?g {_P}:relationType {_P}:belongsToSchool ; {_P}:sourceEntity ?p ; {_P}:targetEntity ?t }} }}",
    f"SELECT node AS p FROM persons WHERE node IN (SELECT source FROM facts WHERE rel_type = '{V}foundsSchool') AND node NOT IN (SELECT source FROM facts WHERE rel_type = '{V}belongsToSchool')",
)
_ad_hoc(
    "sparql_values",
    f"SELECT ?s ?l ?m WHERE {{ VALUES (?l ?m) {{ ('NATION_1' 'one') ('NATION_2' UNDEF) ('none' 'x') }} ?s a {_P}:School ; rdfs:label ?l }}",
    "SELECT l.node AS s, l.label AS l, coalesce(m, '') AS m FROM labels l JOIN (VALUES ('NATION_1', 'one'), ('NATION_2', NULL), ('none', 'x')) v(l, m) ON l.label = v.l",
)
_ad_hoc(
    "sparql_strings",
    f"SELECT ?l ?u ?n ?after WHERE {{ ?s a {_P}:School ; rdfs:label ?l FILTER(REGEX(?l, '^nation_1\\\\d$', 'i')) BIND(LCASE(?l) AS ?u) BIND(STRLEN(?l) AS ?n) BIND(STRAFTER(?l, '_') AS ?after) }}",
    "SELECT label AS l, lower(label) AS u, length(label)::VARCHAR AS n, split_part(label, '_', 2) AS after FROM labels WHERE regexp_matches(label, '^NATION_1[0-9]$')",
)
_ad_hoc(
    "sparql_exists_correlated",
    f"SELECT ?s ?l WHERE {{ ?s a {_P}:School ; rdfs:label ?l FILTER EXISTS {{ ?q a {_P}:School ; rdfs:label ?m FILTER(?m = CONCAT(?l, '0')) }} }}",
    "SELECT node AS s, label AS l FROM labels WHERE label LIKE 'NATION%' AND label || '0' IN (SELECT label FROM labels)",
)
_ad_hoc(
    "sparql_not_exists_correlated",
    f"SELECT ?s ?l WHERE {{ ?s a {_P}:School ; rdfs:label ?l FILTER NOT EXISTS {{ ?q a {_P}:School ; rdfs:label ?m FILTER(?m > ?l && STRSTARTS(?m, 'NATION_1')) }} }}",
    "SELECT node AS s, label AS l FROM labels WHERE label LIKE 'NATION%' AND label >= (SELECT max(label) FROM labels WHERE label LIKE 'NATION\\_1%' ESCAPE '\\')",
)
_ad_hoc(
    "sparql_offset",
    f"SELECT ?l WHERE {{ ?s a {_P}:School ; rdfs:label ?l }} ORDER BY DESC(?l) LIMIT 5 OFFSET 7",
    "SELECT n_name AS l FROM nation ORDER BY n_name DESC LIMIT 5 OFFSET 7",
)
_ad_hoc(
    "sparql_aggregates",
    f"SELECT ?y (MIN(?n) AS ?low) (MAX(?n) AS ?high) (SUM(?n) AS ?total) (AVG(?n) AS ?mean) (SAMPLE(?y) AS ?any) WHERE {{ ?s a {_P}:School ; rdfs:label ?l BIND(STRLEN(?l) AS ?y) BIND(2 * STRLEN(?l) AS ?n) }} GROUP BY ?y",
    "SELECT length(n_name)::VARCHAR AS y, (2 * length(n_name))::VARCHAR AS low, (2 * length(n_name))::VARCHAR AS high, sum(2 * length(n_name))::BIGINT::VARCHAR AS total, (2 * length(n_name))::VARCHAR AS mean, length(n_name)::VARCHAR AS \"any\" FROM nation GROUP BY length(n_name)",
)
_ad_hoc(
    "sparql_aggregate_values",
    f"SELECT ?y (MIN(?n) AS ?low) (MAX(?n) AS ?high) (SUM(?n) AS ?total) (AVG(?n) AS ?mean) (COUNT(DISTINCT ?n) AS ?many) WHERE {{ ?s a {_P}:School ; rdfs:label ?l BIND(STRLEN(?l) AS ?y) BIND(xsd:integer(STRAFTER(?l, 'NATION_')) AS ?n) }} GROUP BY ?y",
    "SELECT length(n_name)::VARCHAR AS y, min(k)::VARCHAR AS low, max(k)::VARCHAR AS high, sum(k)::BIGINT::VARCHAR AS total, CASE WHEN avg(k) = floor(avg(k)) THEN avg(k)::BIGINT::VARCHAR ELSE avg(k)::VARCHAR END AS mean, count(DISTINCT k)::VARCHAR AS many FROM (SELECT n_name, split_part(n_name, '_', 2)::INT AS k FROM nation) GROUP BY length(n_name)",
)
_ad_hoc(
    "sparql_optional_union",
    f"SELECT ?p ?k ?l WHERE {{ {{ ?p a {_P}:School BIND('school' AS ?k) }} UNION {{ ?p a {_P}:Time BIND('time' AS ?k) }} OPTIONAL {{ ?p rdfs:label ?l }} }}",
    f"SELECT {_n('nation', 'n_nationkey')} AS p, 'school' AS k, n_name AS l FROM nation UNION ALL SELECT DISTINCT {_n('year', 'year(o_orderdate)')}, 'time', CASE WHEN year(o_orderdate) % 2 = 0 THEN year(o_orderdate)::VARCHAR ELSE '' END FROM orders",
)
#: The father tree, whose steps a path follows, as direct statements.
_TREE = f"{NODE}customer/1"


def _descendants(spark: SparkSession, sf_dir: str, path: str = f"{_P}:childOf+") -> DataFrame:
    return _tree(spark, sf_dir, f"SELECT ?d WHERE {{ <{_TREE}> {path} ?d }}")


def _tree(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    kg = star_graph(spark, sf_dir)
    none = F.lit(None).cast("string")
    step = kg.facts_of("fatherOf").select(F.col("source").alias("s"), F.lit("iri").alias("s_kind"), F.lit(V + "childOf").alias("p"), F.col("target").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
    tree = replace(kg, others=kg.others.unionByName(step))
    return select(tree, f"{_HEAD}\n{text}")


QUERIES["sparql_path_plus"] = _descendants
ORACLE["sparql_path_plus"] = (
    "WITH RECURSIVE down AS (SELECT c_custkey AS k FROM customer WHERE c_custkey // 2 = 1 AND c_custkey >= 1"
    " UNION SELECT c.c_custkey FROM customer c JOIN down d ON c.c_custkey // 2 = d.k AND c.c_custkey >= 1)"
    f" SELECT '{NODE}customer/' || k::VARCHAR AS d FROM down"
)

for _name, _path, _body in (
    ("sparql_path_sequence", f"{_P}:childOf/{_P}:childOf", "c_custkey // 4 = 1 AND c_custkey // 2 >= 1 AND c_custkey >= 1"),
    ("sparql_path_inverse", f"^{_P}:childOf", "c_custkey = 0"),
    ("sparql_path_alternative", f"({_P}:childOf|^{_P}:childOf)", "c_custkey IN (0, 2, 3)"),
    ("sparql_path_optional", f"{_P}:childOf?", "c_custkey IN (1, 2, 3)"),
):
    QUERIES[_name] = partial(_descendants, path=_path)
    ORACLE[_name] = f"SELECT '{NODE}customer/' || c_custkey::VARCHAR AS d FROM customer WHERE {_body}"


def _descendant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, f"SELECT ?a ?b WHERE {{ ?a {_P}:childOf+ ?b }}")


QUERIES["sparql_path_pairs"] = _descendant_pairs
ORACLE["sparql_path_pairs"] = (
    "WITH RECURSIVE down AS (SELECT c_custkey // 2 AS a, c_custkey AS b FROM customer WHERE c_custkey >= 1 UNION SELECT d.a, c.c_custkey FROM customer c JOIN down d ON c.c_custkey // 2 = d.b AND c.c_custkey >= 1)"
    f" SELECT '{NODE}customer/' || a::VARCHAR AS a, '{NODE}customer/' || b::VARCHAR AS b FROM down"
)


QUERIES["sparql_path_star"] = partial(_descendants, path=f"{_P}:childOf*")
ORACLE["sparql_path_star"] = f"{ORACLE['sparql_path_plus']} UNION SELECT '{_TREE}'"


def _not_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = "|".join(f"{_P}:{n}" for n in ("childOf", "relationType", "sourceEntity", "targetEntity"))
    return _tree(spark, sf_dir, f"SELECT ?a ?d WHERE {{ ?a !({parts}|rdf:type|rdfs:label) ?d }}")


QUERIES["sparql_path_negated"] = _not_named
ORACLE["sparql_path_negated"] = " UNION ALL ".join(f"SELECT {_n('customer', 'o_custkey')} AS a, strftime({day}, '%Y-%m') AS d FROM {_SPANS} WHERE o_custkey % 2 = 0" for day in ("first", "last"))


def _literals(table: str, key: str, predicate: str, value: str, datatype: str | None = None, lang: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The statements ``table/key predicate value`` of a table's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.expr(value).isNotNull())
        none = F.lit(None).cast("string")
        return rows.select(
            F.concat(F.lit(f"urn:{table}:"), F.col(key).cast("string")).alias("s"), F.lit("iri").alias("s_kind"), F.lit(predicate).alias("p"), F.expr(value).cast("string").alias("o"),
            F.lit("literal").alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"), F.col(lang).alias("o_lang") if lang else none.alias("o_lang"),
        )

    return run


def _over(text: str, *statements: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples = reduce(DataFrame.unionByName, [s(spark, sf_dir) for s in statements])
        return select(KnowledgeGraph.from_triples(triples.distinct()), f"{_HEAD}\n{text}")

    return run


_ORDERED = _literals("orders", "o_orderkey", V + "ordered", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")", XSD + "dateTime")
_PRICE = _literals("orders", "o_orderkey", V + "price", "o_totalprice", XSD + "double")
QUERIES["sparql_languages"] = _over(
    'SELECT ?d (LANG(?t) AS ?g) (SHA256(STR(?t)) AS ?h) (STRLEN(STR(?t)) AS ?n) WHERE { ?d rdfs:label ?t FILTER(LANG(?t) = "fr" || LANGMATCHES(LANG(?t), "DE")) }',
    _literals("documents", "doc_id", LABEL, "text", lang="lang"),
)
ORACLE["sparql_languages"] = "SELECT 'urn:documents:' || doc_id::VARCHAR AS d, lang AS g, sha256(text) AS h, length(text)::VARCHAR AS n FROM documents WHERE text IS NOT NULL AND lang IN ('de', 'fr')"
QUERIES["sparql_dates"] = _over(f"SELECT ?y ?m (COUNT(?o) AS ?n) (MIN(DAY(?d)) AS ?low) WHERE {{ ?o {_P}:ordered ?d }} GROUP BY (YEAR(?d) AS ?y) (MONTH(?d) AS ?m)", _ORDERED)
ORACLE["sparql_dates"] = "SELECT year(o_orderdate)::VARCHAR AS y, month(o_orderdate)::VARCHAR AS m, count(*)::VARCHAR AS n, min(day(o_orderdate))::VARCHAR AS low FROM orders GROUP BY year(o_orderdate), month(o_orderdate)"
QUERIES["sparql_numbers"] = _over(
    f"SELECT ?o (FLOOR(?x) AS ?f) (CEIL(?x) AS ?c) (ROUND(?x) AS ?r) (ABS(FLOOR(?x) - 250000) AS ?a) WHERE {{ ?o {_P}:price ?x ; {_P}:ordered ?d FILTER(MONTH(?d) < 4) }}", _ORDERED, _PRICE
)
ORACLE["sparql_numbers"] = (
    "SELECT 'urn:orders:' || o_orderkey::VARCHAR AS o, floor(o_totalprice)::BIGINT::VARCHAR AS f, ceil(o_totalprice)::BIGINT::VARCHAR AS c, floor(o_totalprice + 0.5)::BIGINT::VARCHAR AS r,"
    " abs(floor(o_totalprice)::BIGINT - 250000)::VARCHAR AS a FROM orders WHERE month(o_orderdate) < 4"
)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup over the graph's stored layout, written and read again."""
    path = folder(spark, "stored-graph")
    star_graph(spark, sf_dir).write(path)
    return lookups.courtesy_name(KnowledgeGraph.read(spark, path), TEN)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools and their founders as statements in a file, parsed and asked."""
    path = folder(spark, "statements")
    kept = star_graph(spark, sf_dir).triples().where((F.col("s").startswith(NODE + "nation/") | F.col("s").startswith(NODE + "supplier/") | F.col("s").contains("foundsSchool")) & F.col("o_kind").isin("iri", "literal"))
    iri = lambda c: F.concat(F.lit("<"), F.replace(F.col(c), F.lit("|"), F.lit("%7C")), F.lit(">"))
    line = F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("o_kind") == "iri", iri("o")).otherwise(F.concat(F.lit('"'), F.col("o"), F.lit('"'))), F.lit("."))
    kept.select(line.alias("value")).write.text(path)
    kg = KnowledgeGraph.from_triples(read_ntriples(spark, [path]))
    return select(kg, _FOUNDERS)


#: Bytes of a range of the Turtle files below: small, so that the files of the
#: smallest tables are cut too.
_RANGE = 64 << 10
_FOUNDERS = f"{_HEAD}\nSELECT ?l ?m WHERE {{ ?f a {_P}:Relation ; {_P}:relationType {_P}:foundsSchool ; {_P}:sourceEntity ?p ; {_P}:targetEntity ?s . ?p rdfs:label ?l . ?s rdfs:label ?m }}"


def _turtle_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes in one Turtle folder, facts in another, read again."""
    nodes, facts = folder(spark, "turtle-nodes"), folder(spark, "turtle-facts")
    kg = star_graph(spark, sf_dir)
    triples = replace(kg, facts=kg.facts_of("foundsSchool")).triples().withColumn("s", F.replace("s", F.lit("|"), F.lit("~")))
    prefixes = Vocabulary().prefixes | {"nation": NODE + "nation/"}
    write_turtle(triples.where(F.col("s").startswith(NODE + "nation/") | F.col("s").startswith(NODE + "supplier/")), nodes, prefixes)
    write_turtle(triples.where(F.col("s").contains("foundsSchool~")), facts, prefixes)
    return read_turtle(spark, [nodes], _RANGE), read_turtle(spark, [facts], _RANGE)


def _turtle_founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both folders asked as one graph."""
    nodes, facts = _turtle_parts(spark, sf_dir)
    return select(KnowledgeGraph.from_triples(nodes.unionByName(facts).distinct()), _FOUNDERS)


def _in_graphs(text: str) -> Query:
    """A query over the same folders as two named graphs of a stored dataset."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, facts = _turtle_parts(spark, sf_dir)
        path, said = folder(spark, "dataset"), folder(spark, "quads")
        # The files are parsed once: each table of the dataset would parse them again.
        named({"urn:graph:nodes": nodes, "urn:graph:facts": facts}).write.parquet(said)
        Dataset.from_quads(spark.read.schema(QUADS).parquet(said)).write(path)
        return select(Dataset.read(spark, path), f"{_HEAD}\n{text}")

    return run


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and their nations as N-Quads, a graph a nation: founders by graph."""
    path = folder(spark, "quads")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    own = lambda *parts: F.concat(F.lit("<"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(">"))
    nation, who = own(NODE, "nation/", F.col("s_nationkey")), own(NODE, "supplier/", F.col("s_suppkey"))
    founds, label = F.lit(f"<{V}founds>"), F.lit(f"<{LABEL}>")
    name = F.concat(F.lit('"'), "s_name", F.lit('"'))
    graph = own("urn:graph:", F.col("s_nationkey"))
    lines = supplier.select(F.explode(F.array(F.concat_ws(" ", who, founds, nation, graph, F.lit(".")), F.concat_ws(" ", who, label, name, graph, F.lit(".")))).alias("value"))
    lines.write.text(path)
    data = Dataset.from_quads(read_nquads(spark, [path]))
    return select(data, f"{_HEAD}\nSELECT ?g ?l ?n WHERE {{ GRAPH ?g {{ ?p {_P}:founds ?n . ?p rdfs:label ?l }} }}")


def _turtle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as labelled nodes of Turtle files, whole texts as long
    strings, read in ranges."""
    path = folder(spark, "turtle-documents")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    none, said = F.lit(None).cast("string"), lambda p, o, lang: F.struct(F.lit(p).alias("p"), F.col(o).alias("o"), lang.alias("o_lang"))
    both = docs.select(F.concat(F.lit("urn:doc:"), F.col("doc_id").cast("string")).alias("s"), F.explode(F.array(said(LABEL, "text", F.col("lang")), said(V + "source", "source", none))).alias("t"))
    triples = both.select("s", F.lit("iri").alias("s_kind"), "t.p", "t.o", F.lit("literal").alias("o_kind"), none.alias("o_datatype"), "t.o_lang").where("o is not null")
    write_turtle(triples.select(TRIPLES.fieldNames()), path, Vocabulary().prefixes)
    kg = KnowledgeGraph.from_triples(read_turtle(spark, [path], _RANGE))
    source = kg.literals_of("source").withColumnRenamed("value", "source")
    return kg.labels.join(source, "node").select("node", "lang", "source", F.sha2("label", 256).alias("digest"))


QUERIES["named_graph_counts"] = _in_graphs("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")
ORACLE["named_graph_counts"] = (
    "SELECT 'urn:graph:nodes' AS g, (2 * ((SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)))::VARCHAR AS n"
    " UNION ALL SELECT 'urn:graph:facts', (4 * count(*))::VARCHAR FROM supplier"
)
_SAID = f"?f a {_P}:Relation ; {_P}:relationType {_P}:foundsSchool ; {_P}:sourceEntity ?p ; {_P}:targetEntity ?s"
QUERIES["named_graph_join"] = _in_graphs(f"SELECT ?l ?m ?g WHERE {{ GRAPH <urn:graph:facts> {{ {_SAID} }} GRAPH ?g {{ ?p rdfs:label ?l . ?s rdfs:label ?m }} }}")
ORACLE["named_graph_join"] = "SELECT s_name AS l, n_name AS m, 'urn:graph:nodes' AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey"
QUERIES["dataset_from"] = _in_graphs(f"SELECT ?l ?m FROM <urn:graph:nodes> FROM <urn:graph:facts> WHERE {{ {_SAID} . ?p rdfs:label ?l . ?s rdfs:label ?m }}")
ORACLE["dataset_from"] = "SELECT s_name AS l, n_name AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey"
QUERIES["dataset_from_named"] = _in_graphs(f"SELECT ?g ?l FROM <urn:graph:facts> FROM NAMED <urn:graph:nodes> WHERE {{ {_SAID} GRAPH ?g {{ ?s rdfs:label ?l }} }}")
ORACLE["dataset_from_named"] = "SELECT 'urn:graph:nodes' AS g, n_name AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey"
QUERIES["quad_graphs"] = _quads
ORACLE["quad_graphs"] = f"SELECT 'urn:graph:' || s_nationkey::VARCHAR AS g, s_name AS l, {_n('nation', 's_nationkey')} AS n FROM supplier"
QUERIES |= {"stored_graph": _stored, "parsed_statements": _parsed, "turtle_founders": _turtle_founders, "turtle_documents": _turtle_documents}
ORACLE["turtle_documents"] = "SELECT 'urn:doc:' || doc_id::VARCHAR AS node, lang, source, sha256(text) AS digest FROM documents WHERE text IS NOT NULL"
ORACLE["stored_graph"] = ORACLE["courtesy_name"]
ORACLE["parsed_statements"] = ORACLE["turtle_founders"] = "SELECT s_name AS l, n_name AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey"

# --- questions and answers --------------------------------------------------------

#: Questions and their routes.
GOLDEN = (
    ("文彭是谁？", "tool", "person_labels", ("文彭",)), ("文彭的字是什么？", "tool", "courtesy_name", ("文彭",)), ("文彭的号是什么？", "tool", "art_name", ("文彭",)),
    ("文彭的生卒年是什么？", "tool", "birth_death", ("文彭",)), ("文徵明与文彭是什么关系？", "tool", "pair_relations", ("文徵明", "文彭")),
    ("文彭的师承是？", "tool", "teacher_relations", ("文彭",)), ("谁开创了吴门印派？", "tool", "school_founder", ("吴门印派",)),
    ("某人的师承关系是什么？", "tool", "teacher_relations", ("关系是什么",)), ("某人属于什么流派？", "tool", "school_membership", ("某人",)),
    ("某人的交游圈有哪些人？", "tool", "social_relations", ("某人的",)), ("文彭字是什么", "tool", "courtesy_name", ("是什么",)),
    ("文彭的老师是谁", "tool", "person_labels", ("文彭的老师",)), ("文彭的生卒年", "tool", "person_labels", ("文彭的生卒年",)), ("介绍文彭", "tool", "person_labels", ("文彭",)),
    ("谁创立了某流派", "tool", "school_membership", ("谁创立了某",)), ("谁开创了", "tool", "school_founder", ("谁",)),
    ("文徵明与文彭是什么关系呢请说明", "generated_sparql", "fs_pair", ("文徵明", "文彭")), ("？", "fallback", "", ()), ("", "empty", "", ()),
    ("请比较不同时期人物活动地点的变化", "fallback", "", ()),
)


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden questions about every customer, by a short name that keeps
    their routes: the last two digits of its key."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 90 + 10).cast("string").alias("name"))
    # A file of customers is read by few tasks, and each row becomes many questions.
    customers = customers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    texts = F.explode(F.array(*[F.lit(q) for q, *_ in GOLDEN]))
    questions = customers.select("c_custkey", "name", texts.alias("question")).select("c_custkey", F.replace("question", F.lit("文彭"), "name").alias("question"))
    routed = route_questions(questions)
    return routed.select("c_custkey", "question", "route_type", F.coalesce("intent", F.lit("")).alias("intent"), F.array_join("slots", "|").alias("slots"))


QUERIES["route_questions"] = _route
_SHORT = "(c_custkey % 90 + 10)::VARCHAR"
ORACLE["route_questions"] = (
    f"SELECT c_custkey, replace(question, '文彭', {_SHORT}) AS question, route_type, intent, replace(slots, '文彭', {_SHORT}) AS slots FROM customer, (VALUES "
    + ", ".join(f"('{q}', '{t}', '{i}', '{'|'.join(s)}')" for q, t, i, s in GOLDEN)
    + ") g(question, route_type, intent, slots)"
)

#: What the questions of a table ask of a customer, by its key; 5 is a pair.
_ASKED = {0: "的字是什么？", 1: "的号是什么？", 2: "的生卒年是什么？", 3: "属于什么流派？", 4: "的父亲是谁？", 6: "呢"}


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each customer, each nation, and an empty one a region."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    kind, text = F.col("c_custkey") % 7, F.lit(None).cast("string")
    for k, tail in _ASKED.items():
        text = F.when(kind == k, F.concat("c_name", F.lit(tail))).otherwise(text)
    single = customer.where(kind != 5).select(F.concat(F.lit("c"), "c_custkey").alias("id"), text.alias("question"))
    parent = customer.select(F.col("c_custkey").alias("p"), F.col("c_name").alias("p_name"))
    pairs = customer.where(kind == 5).join(parent, F.floor(F.col("c_custkey") / 2) == F.col("p"))
    pairs = pairs.select(F.concat(F.lit("c"), "c_custkey"), F.concat("p_name", F.lit("与"), "c_name", F.lit("是什么关系？")))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("谁开创了"), "n_name", F.lit("？")))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("r"), "r_regionkey"), F.lit(" "))
    return reduce(DataFrame.union, [single, pairs, nations, regions])


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions in one plan over the stored graph and its index."""
    path = folder(spark, "answered-graph")
    star_graph(spark, sf_dir).write(path)
    got = answer_questions(KnowledgeGraph.read(spark, path), _questions(spark, sf_dir))
    return got.select("id", "question", "mode", F.coalesce("intent", F.lit("")).alias("intent"), "answer", F.size("rows").alias("n_rows"))


def _answered_sql() -> str:
    tails = " ".join(f"WHEN {k} THEN '{t}'" for k, t in _ASKED.items())
    kinds = "['courtesy_name', 'art_name', 'birth_death', 'school_membership', 'family_relations', 'pair_relations', NULL][k + 1]"
    asked = (
        f"qs AS MATERIALIZED (SELECT 'c' || c_custkey::VARCHAR AS id, c_name || CASE k {tails} END AS question, {kinds} AS intent, c_name AS a, NULL AS b FROM (SELECT *, c_custkey % 7 AS k FROM customer) WHERE k <> 5"
        " UNION ALL SELECT 'c' || c.c_custkey::VARCHAR, p.c_name || '与' || c.c_name || '是什么关系？', 'pair_relations', p.c_name, c.c_name FROM customer c JOIN customer p ON p.c_custkey = c.c_custkey // 2 WHERE c.c_custkey % 7 = 5"
        " UNION ALL SELECT 'n' || n_nationkey::VARCHAR, '谁开创了' || n_name || '？', 'school_founder', n_name, NULL FROM nation)"
    )
    named = "persons_named AS MATERIALIZED (SELECT DISTINCT node, label FROM persons)"
    cand = (
        "cand AS MATERIALIZED (SELECT q, person, label FROM (SELECT q, node AS person, label, row_number() OVER (PARTITION BY q ORDER BY node, label) AS r"
        f" FROM (SELECT DISTINCT a AS q FROM qs WHERE intent NOT IN ('pair_relations', 'school_founder')) JOIN persons_named ON {'(contains(label, q) OR contains(q, label))'}) WHERE r <= 30)"
    )
    schools = (
        "schools AS MATERIALIZED (SELECT q, school, schoolLabel FROM (SELECT q, node AS school, label AS schoolLabel, row_number() OVER (PARTITION BY q ORDER BY node, label) AS r"
        " FROM (SELECT DISTINCT a AS q FROM qs WHERE intent = 'school_founder') JOIN (SELECT DISTINCT node, label FROM labels) ON (contains(label, q) OR contains(q, label))) WHERE r <= 30)"
    )
    pair_side = lambda n: f"(SELECT DISTINCT x.{n} AS q, p.node, p.label FROM qs x JOIN persons_named p ON contains(p.label, x.{n}) WHERE x.intent = 'pair_relations')"
    sides = f"side_a AS MATERIALIZED {pair_side('a')}, side_b AS MATERIALIZED {pair_side('b')}, pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM qs WHERE intent = 'pair_relations')"

    def target(rel: str) -> tuple[str, str]:
        return f"SELECT DISTINCT c.q, c.person, c.label, f.target, coalesce(l.label, '') AS o, coalesce(l.label, f.target) AS v FROM cand c JOIN facts f ON f.source = c.person AND f.rel_type = '{V}{rel}' LEFT JOIN labels l ON l.node = f.target", "person, label, target, o, v"

    family = f"SELECT DISTINCT c.q, c.person, c.label, e.other, coalesce(l.label, e.other) AS o, e.tag, e.tag || '：' || coalesce(l.label, e.other) AS v FROM cand c JOIN ends e USING (person) LEFT JOIN labels l ON l.node = e.other"
    birth = (
        "SELECT c.q, c.person, c.label, coalesce(birthYear, '') AS x, coalesce(deathYear, '') AS y, CASE WHEN coalesce(birthYear, '') <> '' OR coalesce(deathYear, '') <> '' THEN trim(coalesce(birthYear, '') || ' - ' || coalesce(deathYear, ''), ' -') END AS v"
        f" FROM cand c LEFT JOIN ({_years_sql('bornIn', 'birthYear')}) b USING (person) LEFT JOIN ({_years_sql('diedIn', 'deathYear')}) d USING (person)"
    )
    founder = f"SELECT DISTINCT s.q, f.source, coalesce(l.label, f.source) AS v, s.school, s.schoolLabel FROM schools s JOIN facts f ON f.target = s.school AND f.rel_type = '{V}foundsSchool' LEFT JOIN labels l ON l.node = f.source"
    way = lambda x, y, tag: f"SELECT p.a || '、' || p.b AS q, a.label AS x, b.label AS y, f.rel_type, coalesce(l.label, '') AS o, '{tag}' AS tag FROM pairs p JOIN side_a a ON a.q = p.a JOIN side_b b ON b.q = p.b JOIN facts f ON f.{x} = a.node AND f.{y} = b.node LEFT JOIN labels l ON l.node = f.rel_type"
    pair = f"SELECT *, tag || '：' || CASE WHEN o <> '' THEN o ELSE rel_type END AS v FROM (SELECT DISTINCT * FROM ({way('source', 'target', lookups.FORWARD)} UNION ALL {way('target', 'source', lookups.BACKWARD)}))"
    rules = {
        "courtesy_name": (*target("hasCourtesyName"), 30, True), "art_name": (*target("hasArtName"), 30, True), "school_membership": (*target("belongsToSchool"), 30, True),
        "birth_death": (birth, "person, label, x, y", 20, False), "family_relations": (family, "person, label, other, o, tag", 40, False),
        "school_founder": (founder, "source, v, school, schoolLabel", 20, True), "pair_relations": (pair, "x, y, rel_type, o, tag", 30, False),
    }
    parts = []
    for intent, (rows, order, most, once) in rules.items():
        placed = f"SELECT q, v, i FROM (SELECT q, v, row_number() OVER (PARTITION BY q ORDER BY {order}) AS i FROM ({rows})) WHERE i <= {most}"
        kept = f"SELECT q, v, min(i) AS i FROM ({placed}) WHERE v IS NOT NULL GROUP BY q, v" if once else f"SELECT q, v, i FROM ({placed}) WHERE v IS NOT NULL"
        listed = f"SELECT q, string_agg(v, '、' ORDER BY i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY i) AS j FROM ({kept})) WHERE j <= 10 GROUP BY q"
        name = answers.SHOWN[intent][1]
        parts.append(
            f"SELECT id, question, 'tool' AS mode, intent, CASE WHEN n IS NULL THEN '图谱中暂时没有查到与“' || s || '”相关的结果。' WHEN t IS NULL THEN '图谱里查到了“' || s || '”的候选实体，但还没有可展示的{name}信息。' ELSE '“' || s || '”的{name}信息包括：' || t END AS answer, coalesce(n, 0)::INT AS n_rows"
            f" FROM (SELECT *, CASE WHEN b IS NULL THEN a ELSE a || '、' || b END AS s FROM qs WHERE intent = '{intent}') x LEFT JOIN (SELECT q, count(*) AS n FROM ({placed}) GROUP BY q) y ON y.q = x.s LEFT JOIN ({listed}) z ON z.q = x.s"
        )
    parts.append(f"SELECT id, question, 'fallback', '', '{FALLBACK}', 0 FROM qs WHERE intent IS NULL UNION ALL SELECT 'r' || r_regionkey::VARCHAR, ' ', 'empty', '', '{EMPTY}', 0 FROM region")
    return _sql(" UNION ALL ".join(parts), asked, named, cand, schools, sides, _both_ends(f"WHERE rel_type = '{V}fatherOf'", lookups.CHILD, lookups.PARENT))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup whose candidates come from the stored index of labels."""
    path = folder(spark, "indexed-graph")
    star_graph(spark, sf_dir).write(path)
    return lookups.related_people(KnowledgeGraph.read(spark, path), TEN)


QUERIES |= {"answer_questions": _answered, "indexed_lookup": _indexed}
ORACLE |= {"answer_questions": _answered_sql(), "indexed_lookup": ORACLE["related_people"]}


def _answer(function, intent: str, *slots: str) -> Query:
    return lambda spark, sf_dir: answers.answer(function(star_graph(spark, sf_dir), *slots), intent, list(slots))


def _answer_sql(rows: str, order: str, value: str, name: str, once: bool, *slots: str) -> str:
    slot = "、".join(slots)
    placed = f"SELECT {value} AS v, row_number() OVER (ORDER BY {order}) AS i FROM ({rows})"
    kept = f"SELECT v, min(i) AS i FROM ({placed}) WHERE v IS NOT NULL GROUP BY v" if once else f"SELECT v, i FROM ({placed}) WHERE v IS NOT NULL"
    return f"SELECT '“{slot}”的{name}信息包括：' || string_agg(v, '、' ORDER BY i) AS answer FROM (SELECT * FROM ({kept}) ORDER BY i LIMIT 10)"


QUERIES["answer_values"] = _answer(lookups.courtesy_name, "courtesy_name", TEN)
ORACLE["answer_values"] = _answer_sql(ORACLE["courtesy_name"], "person, label, courtesyNode, courtesyLabel, courtesyName", "nullif(courtesyName, '')", "字", True, TEN)
QUERIES["answer_birth_death"] = _answer(lookups.birth_death, "birth_death", TEN)
ORACLE["answer_birth_death"] = _answer_sql(ORACLE["birth_death"], "person, label, birthYear, deathYear", "CASE WHEN birthYear <> '' OR deathYear <> '' THEN trim(birthYear || ' - ' || deathYear, ' -') END", "生卒年", False, TEN)
QUERIES["answer_family"] = _answer(lookups.family_relations, "family_relations", TEN)
ORACLE["answer_family"] = _answer_sql(ORACLE["family_relations"], "person, label, relative, relativeLabel, relationType", "CASE WHEN relativeLabel <> '' THEN relationType || '：' || relativeLabel END", "亲属关系对象", False, TEN)
QUERIES["answer_pair"] = _answer(lookups.pair_relations, "pair_relations", *PAIR)
ORACLE["answer_pair"] = _answer_sql(ORACLE["pair_relations"], "sourceLabel, targetLabel, relation, relationLabel, direction", "direction || '：' || coalesce(nullif(relationLabel, ''), relation)", "人物关系", False, *PAIR)

QUERIES["answer_summary"] = lambda spark, sf_dir: answers.summary(lookups.school_membership(star_graph(spark, sf_dir), TEN))
_PARTS = ", ".join(f"CASE WHEN {c} <> '' THEN '{c}=' || {c} END" for c in ("person", "label", "school", "schoolLabel"))
ORACLE["answer_summary"] = (
    f"SELECT '{answers.GENERATED.removesuffix('{shown}')}' || string_agg(concat_ws('，', {_PARTS}), '；' ORDER BY person, label, school, schoolLabel) AS answer"
    f" FROM (SELECT * FROM ({ORACLE['school_membership']}) ORDER BY person, label, school, schoolLabel LIMIT 5)"
)

# --- property graphs -----------------------------------------------------------------


def _network(part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = network.property_graph(lookups.family_relations(star_graph(spark, sf_dir), TEN), "family")
        if part == "nodes":
            return graph.nodes.drop("first")
        if part == "layout":
            return network.circular_layout(graph.nodes).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
        if part == "meta":
            return graph.meta.withColumn("warnings", F.array_join("warnings", "|"))
        return graph.edges

    return run


_ROWS = f"SELECT *, row_number() OVER (ORDER BY person, label, relative, relativeLabel, relationType) AS i FROM ({ORACLE['family_relations']})"
_NODES = f"SELECT id, min(pos) AS first FROM (SELECT label AS id, 2 * i AS pos FROM ({_ROWS}) UNION ALL SELECT relativeLabel, 2 * i + 1 FROM ({_ROWS})) WHERE id <> '' GROUP BY id"
_EDGES = f"SELECT DISTINCT label AS source, relativeLabel AS target, relationType AS l FROM ({_ROWS}) WHERE label <> relativeLabel"
for _part in ("nodes", "edges", "meta", "layout"):
    QUERIES[f"graph_{_part}"] = _network(_part)
ORACLE["graph_nodes"] = f"SELECT id, id AS label, 'person' AS type, 'person' AS \"group\", 22 AS size FROM ({_NODES})"
ORACLE["graph_edges"] = f"SELECT source || '::' || target || '::' || l AS id, source, target, l AS label, l AS relationType FROM ({_EDGES})"
ORACLE["graph_meta"] = f"SELECT 'family' AS source, (SELECT count(*) FROM ({_ROWS})) AS rowCount, (SELECT count(*) FROM ({_NODES})) AS nodeCount, (SELECT count(*) FROM ({_EDGES})) AS edgeCount, '' AS warnings"
ORACLE["graph_layout"] = (
    f"SELECT id, round(380 + 138 * cos(pi() * 2 * k / n - pi() / 2), 6) AS x, round(210 + 138 * sin(pi() * 2 * k / n - pi() / 2), 6) AS y"
    f" FROM (SELECT id, row_number() OVER (ORDER BY first) - 1 AS k, count(*) OVER () AS n FROM ({_NODES}))"
)

#: A lookup for each rule of the edges: its columns and the edge's label.
_RULES = {
    "teacher_relations": (lookups.teacher_relations, (TEN,), "label", "teacherLabel", "'师承'"),
    "social_relations": (lookups.social_relations, (TEN,), "label", "friendLabel", "'交游'"),
    "school_membership": (lookups.school_membership, (TEN,), "label", "schoolLabel", "'所属流派'"),
    "school_founder": (lookups.school_founder, (SCHOOL,), "founderLabel", "schoolLabel", "'开创'"),
    "pair_relations": (lookups.pair_relations, PAIR, "sourceLabel", "targetLabel", "coalesce(nullif(relationLabel, ''), nullif(relation, ''), '直接关系')"),
    "related_people": (lookups.related_people, (TEN,), "label", "relatedLabel", "'关联'"),
}


def _every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = star_graph(spark, sf_dir)
    parts = [network.property_graph(f(kg, *slots), name).edges.select(F.lit(name).alias("lookup"), "id", "relationType") for name, (f, slots, *_) in _RULES.items()]
    return reduce(DataFrame.unionByName, parts)


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warnings for many labels without an edge, for one, and for no row."""
    people = lookups.person_labels(star_graph(spark, sf_dir), TEN).select("label")
    cases = {"many": people, "one": people.where("label LIKE '%10'"), "none": people.where("false")}
    return reduce(DataFrame.unionByName, [network.property_graph(rows, name).meta.withColumn("warnings", F.array_join("warnings", "|")) for name, rows in cases.items()])


QUERIES |= {"graph_rules": _every_rule, "graph_warnings": _warnings}
ORACLE["graph_rules"] = " UNION ALL ".join(
    f"SELECT DISTINCT '{name}' AS lookup, {a} || '::' || {b} || '::' || {label} AS id, {label} AS relationType FROM ({ORACLE[name]}) WHERE {a} <> '' AND {b} <> '' AND {a} <> {b}"
    for name, (_, _, a, b, label) in _RULES.items()
)
ORACLE["graph_warnings"] = (
    f"SELECT 'many' AS source, 10 AS rowCount, 10 AS nodeCount, 0 AS edgeCount, '{network.WARN_NO_EDGE}|{network.WARN_LOOSE}' AS warnings"
    f" UNION ALL SELECT 'one', 1, 1, 0, '{network.WARN_NO_EDGE}|{network.WARN_FEW}' UNION ALL SELECT 'none', 0, 0, 0, ''"
)

# --- extraction ------------------------------------------------------------------------


class _Stub:
    """A client whose response derives from the record: fenced for even ids."""

    def invoke(self, prompt: str) -> str:
        tail = prompt.split("记录编号：", 1)[1]
        record_id, rest = tail.split("\n", 1)
        name, lang, source = rest.split("\n", 1)[0].removeprefix("人物名：").split("|")
        body = json.dumps({
            "entities": [{"name": name, "category": "PERSON", "evidence": name}],
            "attributes": [{"subject": name, "attribute": "lang", "value": lang}, {"subject": name, "attribute": "source", "value": source, "evidence": source}],
            "relations": [{"source": name, "relation": "from", "target": source}],
        })
        return f"```json\n{body}\n```" if int(record_id) % 2 == 0 else body


class _Careless(_Stub):
    """One that answers in prose for ids that end in 3."""

    def invoke(self, prompt: str) -> str:
        record_id = prompt.split("记录编号：", 1)[1].split("\n", 1)[0]
        return "I cannot say." if record_id.endswith("3") else super().invoke(prompt)


#: The folders of kept responses of this driver, by application, tables and client.
_KEPT: dict[tuple[str, str, str], str] = {}


def _extracted(spark: SparkSession, sf_dir: str, client=_Stub, mode: str = "abort") -> DataFrame:
    """Whole documents as records; a prompt is sent once for all queries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = F.concat_ws("|", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "lang", "source")
    records = docs.select(F.col("doc_id").cast("string").alias("record_id"), named.alias("person_name"), F.col("text").alias("source_text"), F.col("n_chars").alias("text_length"))
    at = (spark.sparkContext.applicationId, sf_dir, client.__name__)
    if at not in _KEPT:
        _KEPT[at] = folder(spark, "responses")
    return extraction.extract(records, client, mode=mode, store=_KEPT[at])


def _extract(part: str) -> Query:
    return lambda spark, sf_dir: extraction.flatten(_extracted(spark, sf_dir), part)


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose response is no JSON are set aside, the others go on; all
    are exported as one array and read back."""
    path = f"{folder(spark, 'exported')}/records"
    found = _extracted(spark, sf_dir, _Careless, "quarantine")
    write_json(found.select("record_id", "person_name", F.coalesce("_error", F.lit("")).alias("error"), F.coalesce(F.size("attributes"), F.lit(-1)).alias("n")), path)
    return spark.read.schema("record_id string, person_name string, error string, n int").json(path)


for _part in ("entities", "attributes", "relations"):
    QUERIES[f"extract_{_part}"] = _extract(_part)
_DOC = "doc_id::VARCHAR AS record_id"
_WHO = "'doc-' || doc_id::VARCHAR"
ORACLE["extract_entities"] = f"SELECT {_DOC}, 0 AS position, {_WHO} AS name, 'PERSON' AS category, {_WHO} AS evidence FROM documents"
ORACLE["extract_attributes"] = (
    f"SELECT {_DOC}, 0 AS position, {_WHO} AS subject, 'lang' AS attribute, lang AS value, '' AS evidence FROM documents"
    f" UNION ALL SELECT {_DOC}, 1, {_WHO}, 'source', source, source FROM documents"
)
ORACLE["extract_relations"] = f"SELECT {_DOC}, 0 AS position, {_WHO} AS source, 'from' AS relation, source AS target, '' AS evidence FROM documents"

QUERIES["extract_quarantine"] = _quarantine
ORACLE["extract_quarantine"] = f"SELECT {_DOC}, {_WHO} || '|' || lang || '|' || source AS person_name, CASE WHEN doc_id % 10 = 3 THEN 'not JSON' ELSE '' END AS error, CASE WHEN doc_id % 10 = 3 THEN -1 ELSE 2 END AS n FROM documents"

# --- alignment and scans -----------------------------------------------------------------


def _screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.screen(star_graph(spark, sf_dir))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.status_counts(alignment.screen(star_graph(spark, sf_dir))).withColumn("share", F.round("share", 6))


def _aligned_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons, the external table and the regions of places."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    none = F.lit(None).cast("string")
    base = c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("courtesy"), "c_nationkey", none.alias("birth"), none.alias("death"))
    people = base.select(node("customer", "c_custkey").alias("node"), "name", "courtesy", F.col("c_nationkey").alias("place"), "birth", "death")
    kind = F.col("c_custkey") % 4
    place = F.when(kind == 0, F.col("c_nationkey")).when(kind == 1, (F.col("c_nationkey") + 5) % 25).otherwise((F.col("c_nationkey") + 1) % 25)
    external = base.where(kind != 3).select(F.concat(F.lit("ext/"), F.col("c_custkey").cast("string")).alias("ext_id"), "name", "courtesy", place.alias("place"), "birth", "death")
    regions = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("region"))
    return people, external, regions


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.resolve(alignment.match(*_aligned_tables(spark, sf_dir))).select("node", "status", "tier", F.coalesce("ext_id", F.lit("")).alias("ext_id"), F.array_join("candidates", ",").alias("candidates"), "check_by_hand")


QUERIES |= {"align_screen": _screen, "align_counts": _counts, "align_match": _match}
_STATUS = f"SELECT node, CASE WHEN node IN (SELECT source FROM facts WHERE rel_type IN ('{V}hasCourtesyName', '{V}birthPlace')) THEN 'pending' ELSE 'insufficient_data' END AS status FROM persons"
ORACLE["align_screen"] = _sql(_STATUS)
ORACLE["align_counts"] = _sql(f"SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM persons), 6) AS share FROM ({_STATUS}) GROUP BY status")
ORACLE["align_match"] = (
    f"SELECT '{NODE}customer/' || c_custkey::VARCHAR AS node, ['aligned', 'aligned', 'partial', 'insufficient_data'][c_custkey % 4 + 1] AS status, (c_custkey % 4 + 1)::INT AS tier,"
    " CASE WHEN c_custkey % 4 < 3 THEN 'ext/' || c_custkey::VARCHAR ELSE '' END AS ext_id, CASE WHEN c_custkey % 4 < 3 THEN 'ext/' || c_custkey::VARCHAR ELSE '' END AS candidates, c_custkey % 4 = 1 AS check_by_hand FROM customer"
)



def _contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several candidates, years that exclude each other and names a letter
    apart: each supplier against two external entries of its courtesy name."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    key = F.col("s_suppkey")
    courtesy = F.concat(F.lit("c"), key.cast("string"))
    people = s.select(node("supplier", "s_suppkey").alias("node"), F.col("s_name").alias("name"), courtesy.alias("courtesy"), F.col("s_nationkey").alias("place"), F.lit("1500").alias("birth"), F.lit("1570").alias("death"))
    entry = lambda tag, name, place, birth: s.select(F.concat(F.lit(f"{tag}/"), key.cast("string")).alias("ext_id"), name.alias("name"), courtesy.alias("courtesy"), place.alias("place"), birth.alias("birth"), F.lit("1700").alias("death"))
    # a: one letter more, the same place; b: the same name, and place for even keys; born too late for every third.
    a = entry("a", F.concat("s_name", F.lit("x")), F.col("s_nationkey"), F.lit("1510"))
    b = entry("b", F.col("s_name"), F.when(key % 2 == 0, F.col("s_nationkey")).otherwise(F.lit(-1)), F.when(key % 3 == 0, "1600").otherwise("1505"))
    regions = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("region"))
    got = alignment.resolve(alignment.match(people, a.unionByName(b), regions, name_kind="fuzzy"))
    return got.select("node", "status", "tier", "ext_id", F.array_join("candidates", ",").alias("candidates"))


QUERIES["align_contested"] = _contested
ORACLE["align_contested"] = (
    f"SELECT '{NODE}supplier/' || k AS node, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN 'partial' ELSE 'aligned' END AS status, 1 AS tier, 'a/' || k AS ext_id,"
    " CASE WHEN k % 3 = 0 THEN 'a/' || k ELSE 'a/' || k || ',b/' || k END AS candidates FROM (SELECT s_suppkey AS k FROM supplier)"
)

def _fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without anything else in common: customers against entries that
    leave out, double or change a letter."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("C"), F.substring("c_name", 3, 40))).when(key % 3 == 1, F.concat("c_name", F.lit("7"))).otherwise(F.replace("c_name", F.lit("#"), F.lit("-")))
    external = c.where(key % 2 == 0).select(F.concat(F.lit("ext/"), key.cast("string")).alias("ext_id"), name.alias("name"))
    return alignment.match_names(c.select(node("customer", "c_custkey").alias("node"), F.col("c_name").alias("name")), external)


def _supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, external, regions = _aligned_tables(spark, sf_dir)
    resolved = alignment.resolve(alignment.match(people, external, regions))
    return alignment.supplements(star_graph(spark, sf_dir), resolved, external.withColumn("birth", F.lit("1600"))).select("s", "p", "o", "o_kind")


def _same(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """The star graph with sameAs statements: chains of four customers, and each
    supplier with a customer."""
    kg = star_graph(spark, sf_dir)
    none = F.lit(None).cast("string")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 4 <> 0").select(node("customer", "c_custkey").alias("s"), node("customer", F.col("c_custkey") - 1).alias("o"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(node("customer", F.col("s_suppkey") * 3).alias("s"), node("supplier", "s_suppkey").alias("o"))
    said = c.unionByName(s).select("s", F.lit("iri").alias("s_kind"), F.lit(sameas.SAME).alias("p"), "o", F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
    return replace(kg, others=kg.others.unionByName(said))


def _same_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sameas.same_as(_same(spark, sf_dir))


def _same_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the merged graph, and how many stood under other names."""
    kg = _same(spark, sf_dir)
    facts = sameas.rewritten(kg.facts, sameas.same_as(kg))
    return facts.groupBy("rel_type", "source", "target").agg(F.count("*").alias("n"), F.count_if("was_rewritten").alias("n_rewritten"))


QUERIES |= {"align_fuzzy_names": _fuzzy_names, "align_supplements": _supplements, "same_as_classes": _same_classes, "same_as_facts": _same_facts}
ORACLE["align_fuzzy_names"] = (
    f"SELECT node, ext_id, edits, CASE edits WHEN 0 THEN 'exact' ELSE 'fuzzy' END AS method FROM (SELECT {_n('customer', 'c.c_custkey')} AS node, ext_id, levenshtein(c.c_name, name)::INT AS edits FROM customer c JOIN"
    " (SELECT 'ext/' || c_custkey::VARCHAR AS ext_id, CASE c_custkey % 3 WHEN 0 THEN 'C' || substr(c_name, 3, 40) WHEN 1 THEN c_name || '7' ELSE replace(c_name, '#', '-') END AS name FROM customer WHERE c_custkey % 2 = 0) e"
    " ON abs(length(name) - length(c.c_name)) <= 1) WHERE edits <= 1"
)
_C = "c_custkey % 4"
ORACLE["align_supplements"] = (
    f"SELECT {_n('customer', 'c_custkey')} AS s, '{V}alignmentStatus' AS p, ['aligned', 'aligned', 'partial', 'insufficient_data'][{_C} + 1] AS o, 'literal' AS o_kind FROM customer"
    f" UNION ALL SELECT {_n('customer', 'c_custkey')}, '{V}alignmentMethod', 'tier-' || ({_C} + 1)::VARCHAR, 'literal' FROM customer WHERE {_C} < 3"
    f" UNION ALL SELECT {_n('customer', 'c_custkey')}, unnest(['{sameas.SAME}', '{V}cbdbId', '{V}bornIn']), unnest(['ext/' || c_custkey::VARCHAR, 'ext/' || c_custkey::VARCHAR, '1600']), unnest(['iri', 'literal', 'literal']) FROM customer WHERE {_C} < 2"
)
_SAME = (
    f"said AS (SELECT {_n('customer', 'c_custkey')} AS a, {_n('customer', 'c_custkey - 1')} AS b FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT {_n('customer', 's_suppkey * 3')}, {_n('supplier', 's_suppkey')} FROM supplier),"
    " edges AS MATERIALIZED (SELECT a, b FROM said UNION SELECT b, a FROM said), reach AS (SELECT DISTINCT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),"
    " same AS MATERIALIZED (SELECT a AS node, min(b) AS canonical FROM reach GROUP BY a)"
)
ORACLE["same_as_classes"] = f"WITH RECURSIVE {_SAME} SELECT node, canonical FROM same"
ORACLE["same_as_facts"] = (
    f"WITH RECURSIVE {GRAPH_SQL}, {_SAME} SELECT rel_type, coalesce(x.canonical, source) AS source, coalesce(y.canonical, target) AS target, count(*) AS n,"
    " count(CASE WHEN x.canonical <> source OR y.canonical <> target THEN 1 END) AS n_rewritten FROM facts LEFT JOIN same x ON x.node = source LEFT JOIN same y ON y.node = target GROUP BY 1, 2, 3"
)

QUERIES["triples_scan"] = lambda spark, sf_dir: star_graph(spark, sf_dir).triples().groupBy("p", "o_kind").agg(F.count("*").alias("n"))
ORACLE["triples_scan"] = _sql(
    "SELECT p, o_kind, count(*) AS n FROM ("
    f"SELECT rel_type, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{V}relationType', '{V}sourceEntity', '{V}targetEntity']) AS p, 'iri' AS o_kind FROM facts"
    " UNION ALL SELECT '', 'http://www.w3.org/2000/01/rdf-schema#label', 'literal' FROM labels"
    " UNION ALL SELECT '', p, 'literal' FROM literals"
    " UNION ALL SELECT '', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'iri' FROM (SELECT node FROM persons UNION ALL SELECT n_name FROM nation"
    " UNION ALL SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT DISTINCT o_orderpriority FROM orders UNION ALL SELECT DISTINCT year(o_orderdate)::VARCHAR FROM orders)"
    ") GROUP BY p, o_kind"
)
QUERIES["label_union"] = lambda spark, sf_dir: answers.table(lookups.courtesy_name(star_graph(spark, sf_dir), TEN), lookups.school_membership(star_graph(spark, sf_dir), TEN))
ORACLE["label_union"] = (
    f"SELECT person, label, courtesyNode, courtesyLabel, courtesyName, '' AS school, '' AS schoolLabel FROM ({ORACLE['courtesy_name']})"
    f" UNION ALL SELECT person, label, '', '', '', school, schoolLabel FROM ({ORACLE['school_membership']})"
)

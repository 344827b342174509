"""Merkle fingerprints of documents over sections and paragraphs.

A text is a list of sections (parted by blank lines), a section a list of
paragraphs (parted by line breaks), a paragraph a list of pieces of 12 to about
120 code points whose ends its content decides (``PIECE``, also in scripts
without white space); all three splits lose nothing. A piece is a leaf, its
digest the MD5 of its text; a paragraph's digest is the MD5 of its leaves'
digests, a section's that of its paragraphs', the root the SHA-256 of the
sections' digests. So two texts are equal if their roots are, and descending
only into branches whose digests differ leads to the edits.

Likeness is the share of leaves that two trees have in common: the leaves of
branches that are equal at their place, found by that descent, and of the
leaves in differing branches as many as occur in both, copies counted, doubled
and divided by the leaves of both trees.

The printed form is ``root:section(paragraph[leaves],...);...``: the root in
full, the inner digests by their first 16 hex digits, leaves by their first 8,
which are what likeness compares.

Only built-in functions run. Defined results: a null text is an empty text
(one section with one empty paragraph, no leaf); equal roots are alike 1.0,
also of empty texts; a text without leaves is alike 0.0 to any other text.
Rows of equal ids follow each other in the order of a hash of their text, null
ids come last, repeated rows follow each other, a single row follows itself.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import code_points, shuffle_partitions

#: A piece ends after a vowel or mark and a blank, a capital and a small letter
#: of two halves of the alphabet, or a character of one in eight blocks of the
#: East Asian scripts.
_BLOCKS = "".join(rf"\x{{{b:x}}}-\x{{{b + 0x3F:x}}}" for b in range(0x3040, 0xD800, 0x200))
PIECE = rf"(?s).{{10,118}}?(?:[aeoy.!?,;:][ \t]|[A-M][n-z]|.[{_BLOCKS}])|.{{1,120}}"


def _md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def tree(text: Column) -> Column:
    """struct(sections array<struct(digest, paragraphs array<struct(digest,
    leaves array<string>)>)>)."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), _md5)
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))
    paragraph = lambda d: F.struct(_md5(F.array_join(d, "")).alias("digest"), F.transform(d, lambda x: F.substring(x, 1, 8)).alias("leaves"))
    paragraphs = F.transform(split, lambda s: F.transform(s, paragraph))
    sections = F.transform(paragraphs, lambda p: F.struct(_md5(F.array_join(F.transform(p, lambda x: x["digest"]), "")).alias("digest"), p.alias("paragraphs")))
    return F.struct(sections.alias("sections"))


def root(sections: Column) -> Column:
    return _sha(F.array_join(F.transform(sections, lambda s: s["digest"]), ""))


def printed(root_digest: Column, sections: Column) -> Column:
    short = lambda d: F.substring(d, 1, 16)
    paragraph = lambda p: F.concat(short(p["digest"]), F.lit("["), F.array_join(p["leaves"], ""), F.lit("]"))
    section = lambda s: F.concat(short(s["digest"]), F.lit("("), F.array_join(F.transform(s["paragraphs"], paragraph), ","), F.lit(")"))
    return F.concat(root_digest, F.lit(":"), F.array_join(F.transform(sections, section), ";"))


def leaf_count(sections: Column) -> Column:
    inner = lambda s: F.aggregate(s["paragraphs"], F.lit(0), lambda n, p: n + F.size(p["leaves"]))
    return F.aggregate(sections, F.lit(0), lambda n, s: n + inner(s))


def _differing(sections_a: Column, sections_b: Column, of) -> Column:
    """What ``of`` (paragraph, section place, paragraph place) gives for the
    paragraphs of a that b lacks at their place; equal sections are not
    descended into."""

    def inside(s: Column, i: Column) -> Column:
        other = F.get(sections_b, i)
        same = lambda p, j: F.coalesce(F.get(other["paragraphs"], j)["digest"] == p["digest"], F.lit(False))
        found = F.filter(F.transform(s["paragraphs"], lambda p, j: F.when(~same(p, j), of(p, i, j))), lambda x: x.isNotNull())
        return F.when(~F.coalesce(other["digest"] == s["digest"], F.lit(False)), found)

    return F.flatten(F.filter(F.transform(sections_a, inside), lambda x: x.isNotNull()))


def changed_paragraphs(sections_a: Column, sections_b: Column) -> Column:
    """The (section, paragraph) places of a whose branches b lacks at that place."""
    return _differing(sections_a, sections_b, lambda p, i, j: F.struct(i.alias("section"), j.alias("paragraph")))


def changed_leaves(sections_a: Column, sections_b: Column) -> Column:
    """The leaves of a below the paragraphs that b lacks at their place."""
    return F.flatten(_differing(sections_a, sections_b, lambda p, i, j: p["leaves"]))


def _runs(items: Column) -> Column:
    """The distinct items in order with their numbers: struct(d, n)."""
    ordered = F.sort_array(items)
    firsts = lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) != x), F.struct(x.alias("d"), i.alias("i")))), lambda x: x.isNotNull())
    counted = lambda f, size: F.transform(f, lambda x, k: F.struct(x["d"].alias("d"), (F.coalesce(F.get(f, k + 1)["i"], size) - x["i"]).alias("n")))
    # Each list is bound once by a transform of a list of one.
    return F.flatten(F.transform(F.array(ordered), lambda a: F.flatten(F.transform(F.array(firsts(a)), lambda f: counted(f, F.size(a))))))


def shared_items(a: Column, b: Column) -> Column:
    """How many items occur in both lists, copies counted."""
    merged = F.array(F.sort_array(F.concat(_runs(a), _runs(b))))
    both = lambda m: F.aggregate(F.transform(m, lambda x, i: F.when((i > 0) & (F.get(m, i - 1)["d"] == x["d"]), F.least(F.get(m, i - 1)["n"], x["n"])).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.get(F.transform(merged, both), F.lit(0))


def likeness(root_a: Column, a: Column, root_b: Column, b: Column) -> Column:
    each = leaf_count(a) + leaf_count(b)
    apart_a, apart_b = changed_leaves(a, b), changed_leaves(b, a)
    both = leaf_count(a) - F.size(apart_a) + shared_items(apart_a, apart_b)
    return F.when(root_a == root_b, F.lit(1.0)).when(each == 0, F.lit(0.0)).otherwise(2.0 * both / each)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_chars, root, sections, fingerprint) for each row."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    got = base.select("*", code_points(F.col("text")).alias("n_chars"), tree(F.col("text"))["sections"].alias("sections"))
    return got.withColumn("root", root(F.col("sections"))).withColumn("fingerprint", printed(F.col("root"), F.col("sections")))


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def with_next(rows: DataFrame, key: str, text: str, carry: list[str], range_bytes: int = 256 << 20, fan: int = 256) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows in descending ``key``
    (ties by a hash of the text, nulls last; the first row follows the last).

    Keys are cut into ranges at approximate quantiles, about ``range_bytes`` of
    text each; a key that fills several ranges is cut further by the hash. A
    window runs inside each range. Which range follows which is known from
    their numbers alone; only then the first row of each goes to the one before.
    """
    spark = rows.sparkSession
    order, tie = F.coalesce(F.col(key), F.lit(-(1 << 63))), F.shiftrightunsigned(F.xxhash64(text), 11)
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    # Never more ranges than a few rows each, whatever the partitions.
    ranges = max(2, min(fan * fan, max(8 * shuffle_partitions(spark), total // range_bytes), count // 16))
    shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    cuts = rows.select(F.percentile_approx(order, shares, F.lit(10 * ranges)).alias("c")).first()["c"] or []
    hot = {c: n for c, n in Counter(cuts).items() if n > 1}
    bounds = sorted({*cuts, *[c - 1 for c in hot if c > -(1 << 63)]})
    # Two steps, so that a row meets 2 * fan bounds at most.
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    below = lambda bs: F.size(F.filter(bs, lambda b: b < F.col("_order")))
    group = below(_longs([g[-1] for g in groups]))
    lists = F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";")
    part = F.when(group < len(groups), group * fan + below(F.coalesce(F.split(F.get(lists, group), ",").cast("array<bigint>"), _longs([])))).otherwise(len(groups) * fan)
    # A hot key is alone between its bounds, so its pieces go by the part.
    pieces = F.coalesce(F.get(_longs([hot.get(b, 1) for b in bounds]), part), F.lit(1)) if hot else F.lit(1)
    sub = F.least(F.floor(F.col("_tie") / F.lit(float(1 << 53)) * pieces), pieces - 1)
    held = rows.withColumn("_order", order).withColumn("_tie", tie).withColumn("_range", (part.cast("long") * (fan * fan) + sub.cast("long")))
    w = Window.partitionBy("_range").orderBy(F.col("_order").desc(), F.col("_tie").desc(), F.col(text).desc())
    placed = held.select("*", F.row_number().over(w).alias("_n"), *[F.lead(c).over(w).alias(f"next_{c}") for c in carry], F.lead(F.lit(1)).over(w).alias("_inside"))
    # Numbers of ranges only meet in this window, one row each.
    chain = Window.orderBy(F.col("_range").desc())
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = held.select("_range").distinct().select(F.coalesce(F.lead("_range").over(chain), F.first("_range").over(whole)).alias("_of"), F.col("_range").alias("_before"))
    first = held.groupBy("_range").agg(F.max(F.struct("_order", "_tie", F.col(text).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry])).alias("_top"))
    heads = first.join(F.broadcast(follows), F.col("_range") == F.col("_of")).select("_before", *[F.col(f"_top._c_{c}").alias(f"_head_{c}") for c in carry])
    out = placed.join(heads.hint("merge"), F.col("_range") == F.col("_before"), "left")
    for c in carry:
        out = out.withColumn(f"next_{c}", F.when(F.col("_inside").isNotNull(), F.col(f"next_{c}")).otherwise(F.col(f"_head_{c}")))
    return out.drop("_range", "_order", "_tie", "_n", "_inside", "_before", *[f"_head_{c}" for c in carry])


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts: the last third of
    the code points replaced by the start of the next document; ``edits`` lists
    the places section.paragraph that the edit reached."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(base, "doc_id", "text", ["text"]).withColumn("n_chars", code_points(F.col("text")))
    # Trees are built after the one shuffle of the texts, so it moves nothing else.
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third))
    got = rows.withColumn("edited", edited).select("doc_id", "n_chars", "edited", *[tree(F.col(c))["sections"].alias(x) for x, c in (("t", "text"), ("e", "edited"), ("n", "next_text"))])
    got = got.select("*", *[root(F.col(x)).alias(f"{x}_root") for x in "ten"])
    near = lambda x: likeness(F.col("t_root"), F.col("t"), F.col(f"{x}_root"), F.col(x))
    return got.select(
        "doc_id",
        "n_chars",
        _sha(F.col("edited")).alias("edited_sha256"),
        printed(F.col("t_root"), F.col("t")).alias("fingerprint"),
        printed(F.col("e_root"), F.col("e")).alias("edited_fingerprint"),
        near("e").alias("near_edited"),
        near("n").alias("near_next"),
        F.array_join(F.transform(changed_paragraphs(F.col("t"), F.col("e")), lambda c: F.concat_ws(".", c["section"], c["paragraph"])), ",").alias("edits"),
    )


#: DuckDB SQL for ``edit_report`` over the view documents (distinct doc_ids).
#: Leaves are compared without the descent: by their numbers in both texts.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), followed AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM base WINDOW w AS (ORDER BY doc_id DESC)
), texts AS (
  SELECT doc_id, 't' AS kind, text AS x FROM followed
  UNION ALL SELECT doc_id, 'n', following FROM followed
  UNION ALL SELECT doc_id, 'e', left(text, length(text) - length(text) // 3) || left(following, length(text) // 3) FROM followed
), sections AS (
  SELECT doc_id, kind, unnest(string_split(x, E'\n\n')) AS s, generate_subscripts(string_split(x, E'\n\n'), 1) - 1 AS i FROM texts
), paragraphs AS (
  SELECT doc_id, kind, i, unnest(string_split(s, E'\n')) AS p, generate_subscripts(string_split(s, E'\n'), 1) - 1 AS j FROM sections
), cut AS (
  SELECT *, list_transform(regexp_extract_all(p, '@PIECE@'), lambda x: md5(x)) AS full_leaves FROM paragraphs
), digests AS (
  SELECT *, md5(array_to_string(full_leaves, '')) AS digest, list_transform(full_leaves, lambda x: x[1:8]) AS leaves FROM cut
), above AS (
  SELECT doc_id, kind, i, md5(string_agg(digest, '' ORDER BY j)) AS digest,
    string_agg(digest[1:16] || '[' || array_to_string(leaves, '') || ']', ',' ORDER BY j) AS shown
  FROM digests GROUP BY doc_id, kind, i
), roots AS (
  SELECT doc_id, kind, sha256(string_agg(digest, '' ORDER BY i)) AS root, string_agg(digest[1:16] || '(' || shown || ')', ';' ORDER BY i) AS shown FROM above GROUP BY doc_id, kind
), leaves AS (
  SELECT doc_id, kind, leaf, count(*) AS n FROM (SELECT doc_id, kind, unnest(leaves) AS leaf FROM digests) GROUP BY doc_id, kind, leaf
), totals AS (
  SELECT doc_id, kind, sum(n) AS n FROM leaves GROUP BY doc_id, kind
), common AS (
  SELECT a.doc_id, b.kind, sum(least(a.n, b.n)) AS n FROM leaves a JOIN leaves b ON a.doc_id = b.doc_id AND a.leaf = b.leaf AND a.kind = 't' AND b.kind <> 't' GROUP BY a.doc_id, b.kind
), near AS (
  SELECT r.doc_id, r.kind, CASE WHEN r.root = t.root THEN 1.0::DOUBLE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(c.n, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0)) END AS near
  FROM roots r JOIN roots t ON t.doc_id = r.doc_id AND t.kind = 't'
  LEFT JOIN totals x ON x.doc_id = r.doc_id AND x.kind = 't' LEFT JOIN totals y ON y.doc_id = r.doc_id AND y.kind = r.kind
  LEFT JOIN common c ON c.doc_id = r.doc_id AND c.kind = r.kind
), places AS (
  SELECT a.doc_id, string_agg(a.i || '.' || a.j, ',' ORDER BY a.i, a.j) AS edits FROM digests a
  WHERE a.kind = 't' AND NOT EXISTS (SELECT 1 FROM digests b WHERE b.doc_id = a.doc_id AND b.kind = 'e' AND b.i = a.i AND b.j = a.j AND b.digest = a.digest) GROUP BY a.doc_id
)
SELECT b.doc_id, length(b.text) AS n_chars, sha256(e.x) AS edited_sha256, t.root || ':' || t.shown AS fingerprint, u.root || ':' || u.shown AS edited_fingerprint,
  m.near AS near_edited, n.near AS near_next, coalesce(p.edits, '') AS edits
FROM base b JOIN texts e ON e.doc_id = b.doc_id AND e.kind = 'e' JOIN roots t ON t.doc_id = b.doc_id AND t.kind = 't' JOIN roots u ON u.doc_id = b.doc_id AND u.kind = 'e'
JOIN near m ON m.doc_id = b.doc_id AND m.kind = 'e' JOIN near n ON n.doc_id = b.doc_id AND n.kind = 'n' LEFT JOIN places p ON p.doc_id = b.doc_id
""".replace("@PIECE@", PIECE)

"""Alignment of persons with an external authority: screening, tiered matching,
ranking of several candidates, and the statements that a match adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.graph import KnowledgeGraph
from lattica.plans.model import OWL, TRIPLES

#: States, and the relations that give a clue.
ALIGNED, PARTIAL, PENDING, INSUFFICIENT = "aligned", "partial", "pending", "insufficient_data"
CLUES = ("hasCourtesyName", "birthPlace")


def screen(kg: KnowledgeGraph) -> DataFrame:
    """(node, status): pending with a clue, insufficient_data without."""
    v = kg.vocabulary
    people = kg.types.where(F.col("cls") == v("Person")).select("node").distinct()
    clues = kg.facts.where(F.col("rel_type").isin(*[v(c) for c in CLUES])).select(F.col("source").alias("_n")).distinct()
    joined = people.join(clues, F.col("node") == F.col("_n"), "left")
    return joined.select("node", F.when(F.col("_n").isNotNull(), F.lit(PENDING)).otherwise(F.lit(INSUFFICIENT)).alias("status"))


def status_counts(screened: DataFrame) -> DataFrame:
    """(status, n, share)."""
    counts = screened.groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def match(people: DataFrame, external: DataFrame, regions: DataFrame, name_kind: str = "exact", most_edits: int = 1) -> DataFrame:
    """The candidates of persons (node, name, courtesy, place, birth, death)
    among external (ext_id, name, courtesy, place, birth, death), with their
    tier: 1 the courtesy name and the place agree, 2 the courtesy name and the
    region (place, region), 3 the courtesy name alone. The join is on the
    courtesy name and, with exact names, the name; fuzzy names differ by at most
    ``most_edits`` inside equal courtesy names. Candidates whose years exclude
    each other go. A person without candidates has tier 4.
    """
    p = people.select(*[F.col(c).alias(f"p_{c}") for c in ("name", "courtesy", "place", "birth", "death")], "node")
    e = external.select("ext_id", *[F.col(c).alias(f"e_{c}") for c in ("name", "courtesy", "place", "birth", "death")])
    on = F.col("p_courtesy") == F.col("e_courtesy")
    on &= (F.col("p_name") == F.col("e_name")) if name_kind == "exact" else (F.levenshtein("p_name", "e_name") <= most_edits)
    found = p.join(e, on, "left")
    for side in ("p", "e"):
        found = found.join(regions.select(F.col("place").alias(f"{side}_at"), F.col("region").alias(f"{side}_region")), F.col(f"{side}_place") == F.col(f"{side}_at"), "left")
    agrees = lambda c: F.coalesce(F.col(f"p_{c}") == F.col(f"e_{c}"), F.lit(False))
    tier = F.when(F.col("ext_id").isNull(), 4).when(agrees("place"), 1).when(agrees("region"), 2).otherwise(3)
    years = F.coalesce(_same_era(), F.lit(True))
    dated = found.withColumn("ext_id", F.when(years, F.col("ext_id"))).withColumn("tier", tier)
    # An excluded candidate leaves its person without one only if no other stays.
    best = Window.partitionBy("node").orderBy(F.col("tier"), F.col("ext_id"))
    return dated.withColumn("_r", F.row_number().over(best)).where("ext_id is not null or _r = 1").select("node", F.col("p_name").alias("name"), "ext_id", "tier")


def _same_era() -> Column:
    """Neither dies before the other is born; unknown years exclude nothing."""
    year = lambda c: F.expr(f"try_cast({c} AS INT)")
    return F.coalesce(year("p_birth") <= year("e_death"), F.lit(True)) & F.coalesce(year("e_birth") <= year("p_death"), F.lit(True))


def _without(names: DataFrame, most: int) -> DataFrame:
    """(name, rest) for each name and what is left of it without up to ``most``
    of its code points. Two names that so many edits lead from one to the other
    share a rest."""
    rest = F.array("name")
    for _ in range(most):
        shorter = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.concat(F.substring(r, F.lit(1), i - 1), F.substring(r, i + 1, F.length(r))))
        all_shorter = F.flatten(F.transform(F.filter("_rest", lambda r: r != ""), shorter))
        names = names.withColumn("_rest", rest).withColumn("_rest", F.array_distinct(F.concat("_rest", all_shorter)))
        rest = F.col("_rest")
    return names.select("name", F.explode(rest).alias("rest"))


def match_names(people: DataFrame, external: DataFrame, most_edits: int = 1) -> DataFrame:
    """(node, ext_id, edits, method): people (node, name) and external entries
    (ext_id, name) whose names are equal or ``most_edits`` edits apart, whatever
    else they have. Distinct names meet on what deletions leave of them, an
    equality, and the edits are counted of those that do; no name meets all.
    Null names match nothing."""
    mine = _without(people.select("name").where("name is not null").distinct(), most_edits)
    theirs = _without(external.select("name").where("name is not null").distinct(), most_edits).withColumnRenamed("name", "e_name")
    # Spark takes the rests for as few as the names and would send them all to every task.
    pairs = mine.hint("merge").join(theirs, "rest").select("name", "e_name").distinct()
    pairs = pairs.withColumn("edits", F.levenshtein("name", "e_name")).where(F.col("edits") <= most_edits)
    found = people.select("node", "name").hint("merge").join(pairs, "name").hint("merge").join(external.select("ext_id", F.col("name").alias("e_name")), "e_name")
    return found.select("node", "ext_id", "edits", F.when(F.col("edits") == 0, F.lit("exact")).otherwise(F.lit("fuzzy")).alias("method"))


def resolve(matches: DataFrame) -> DataFrame:
    """(node, status, tier, ext_id, candidates): the best candidate of each
    person. One at tier 1 or 2 is aligned (2 to be checked by hand), several of
    a tier or tier 3 are partial with all candidates kept, none is
    insufficient_data. A person's candidates are those of one name, so they are
    few and stay together."""
    ranked = matches.withColumn("best", F.min("tier").over(Window.partitionBy("node")))
    by = ranked.groupBy("node").agg(
        F.min("tier").alias("tier"),
        F.min_by("ext_id", F.struct("tier", "ext_id")).alias("ext_id"),
        F.sum((F.col("tier") == F.col("best")).cast("int")).alias("_ties"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ext_id").isNotNull(), F.struct("tier", "ext_id")))), lambda c: c["ext_id"]).alias("candidates"),
    )
    status = F.when(F.col("tier") == 4, INSUFFICIENT).when((F.col("tier") == 3) | (F.col("_ties") > 1), PARTIAL).otherwise(ALIGNED)
    return by.select("node", status.alias("status"), "tier", "ext_id", "candidates", (F.col("tier") == 2).alias("check_by_hand"))


def supplements(kg: KnowledgeGraph, resolved: DataFrame, external: DataFrame) -> DataFrame:
    """The statements that resolved persons gain, as triples."""
    v = kg.vocabulary
    joined = resolved.join(external.select(F.col("ext_id").alias("_e"), "birth", "death"), F.col("ext_id") == F.col("_e"), "left")
    sure = F.col("status") == ALIGNED
    text = lambda p, c, when=F.lit(True): F.struct(F.lit(p).alias("p"), F.when(when, c.cast("string")).alias("o"), F.lit("literal").alias("o_kind"))
    method = F.concat(F.lit("tier-"), F.col("tier").cast("string"))
    said = F.array(
        F.struct(F.lit(OWL + "sameAs").alias("p"), F.when(sure, F.col("ext_id")).alias("o"), F.lit("iri").alias("o_kind")),
        text(v("alignmentStatus"), F.col("status")), text(v("alignmentMethod"), method, F.col("tier") < 4), text(v("cbdbId"), F.col("ext_id"), sure),
        text(v("bornIn"), F.col("birth"), sure), text(v("diedIn"), F.col("death"), sure),
    )
    none = F.lit(None).cast("string")
    rows = joined.select(F.col("node").alias("s"), F.explode(said).alias("t")).where("t.o is not null")
    return rows.select("s", F.lit("iri").alias("s_kind"), "t.p", "t.o", "t.o_kind", none.alias("o_datatype"), none.alias("o_lang")).select(TRIPLES.fieldNames())

"""Pairs of similar sets by their rarest tokens, with nothing left out.

The tokens of a set are ordered from rare to common. Of two sets of na and nb
tokens with Jaccard similarity of percent/100 at least, the first token that they
share is followed in both by what else they share, so that in each of them at
least percent * (na + nb) / (100 + percent) tokens remain from it on. A set is
posted under those of its tokens only from which enough remain for some partner:
as the smaller of two it needs partners of its own size or more, as the larger
one down to percent of its size. Tokens of a single set are counted in the order
but never posted. What a template puts into all sets comes last in the order and
is posted by those sets only that are similar through it.

Sizes are cut into bands of five percent. A posting of a smaller set goes to its
band, one of a larger set to the bands whose sizes it may still meet there. The
order is exact and global, by two aggregations; no count is sampled or sketched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 1.05


def _band(n: Column) -> Column:
    return F.floor(F.ln(n) / F.ln(F.lit(BAND))).cast("int")


def postings(tokens: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n, r) from (rep, token), distinct, and (rep, n), the size of
    each set: the tokens under which a set has to be found, each with the number
    r of tokens from it on."""
    common = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    ordered = tokens.join(common, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("order"))
    ordered = ordered.join(sizes, "rep").withColumn("spare", F.size("order") - F.ceil(F.col("n") * percent / 100.0).cast("int") + 1).where("spare > 0")
    first = ordered.select("rep", "n", F.size("order").alias("all"), F.posexplode(F.slice("order", F.lit(1), F.col("spare"))).alias("at", "item"))
    return first.select(F.col("item.token").alias("token"), "rep", F.col("n").cast("long").alias("n"), (F.col("all") - F.col("at")).cast("long").alias("r"))


def _smaller(rows: DataFrame, percent: int) -> DataFrame:
    kept = rows.where((100 + percent) * F.col("r") >= 2 * percent * F.col("n"))
    return kept.select("token", _band(F.col("n")).alias("band"), *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "r", "label")])


def _larger(rows: DataFrame, percent: int) -> DataFrame:
    most = F.least(F.col("n"), F.floor((100 + percent) * F.col("r") / percent).cast("long") - F.col("n"))
    least = F.ceil(percent * F.col("n") / 100.0).cast("long")
    met = rows.withColumn("most", most).withColumn("least", F.greatest(least, F.lit(1))).where("most >= least")
    return met.select("token", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))).alias("band"), *[F.col(c).alias(f"{c}_a") for c in ("rep", "n", "r", "label")])


def _possible(percent: int) -> Column:
    enough = (100 + percent) * F.least("r_a", "r_b") >= percent * (F.col("n_a") + F.col("n_b"))
    return enough & (F.col("label_a") != F.col("label_b"))


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def nearest(rows: DataFrame, percent: int) -> DataFrame:
    """At most one pair (a, b) for each set of (token, rep, n, r, label): with one
    of the least and the greatest label under its tokens, if another label than
    its own, and of these with the one that shares the rarest token."""
    under = _smaller(rows, percent).groupBy("token", "band").agg(
        F.min(F.struct("label_b", (-F.col("r_b")).alias("o"), "rep_b", "n_b", "r_b")).alias("low"),
        F.max(F.struct("label_b", F.col("r_b").alias("o"), "rep_b", "n_b", "r_b")).alias("high"),
    )
    met = _larger(rows, percent).join(under, ["token", "band"]).withColumn("it", F.explode(F.array("low", "high")))
    met = met.select("rep_a", "n_a", "r_a", "label_a", "it.rep_b", "it.n_b", "it.r_b", "it.label_b").where(_possible(percent))
    best = met.groupBy("rep_a").agg(F.max(F.struct(F.least("r_a", "r_b").alias("r"), (-F.col("label_b")).alias("o"), "rep_b")).alias("best"))
    return _ends(best.select("rep_a", "best.rep_b")).distinct()


def pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of unequal labels of (token, rep, n, r, label) that can be
    similar enough. Under a token whose sets mostly have one label, these meet the
    others only, so sets that are already linked cost nothing."""
    small, large = _smaller(rows, percent), _larger(rows, percent)
    both = small.select("token", "band", F.col("label_b").alias("label")).unionByName(large.select("token", "band", F.col("label_a").alias("label")))
    mixed = both.groupBy("token", "band", "label").agg(F.count("*").alias("m"))
    mixed = mixed.groupBy("token", "band").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    small, large = small.join(mixed, ["token", "band"]), large.join(mixed, ["token", "band"]).withColumnRenamed("top", "top_a")
    once = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("rep_a") > F.col("rep_b")))
    apart = large.where("label_a <> top_a").join(small, ["token", "band"])
    rest = large.where("label_a = top_a").join(small.where("label_b <> top"), ["token", "band"])
    return _ends(apart.unionByName(rest).where(_possible(percent) & once)).distinct()

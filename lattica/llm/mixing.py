"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the mix in words by its weight, stops at ``most``
times its own words, and what it cannot take is shared anew by weight among
the rest until none is above (solved in closed form: sources in order of the
level at which they are full, and the first level that the next one does not
reach). Inside a source a document of weight w is to be taken min(most, level * w)
times on average, with the level at which these add up to the source's target in
words (closed form over the classes of equal weight). The whole part of that is
allocated for certain; the rest is drawn without replacement: with inclusion
probability p (what is left of the average) and a uniform u from a hash of its
id, a document's rank is its random odds u/(1-u) divided by its inclusion odds
p/(1-p), and documents are taken in that order while the target is nearer with
them than without them. So a source misses its target by half a document at
most, and a rerun takes the same documents. Weights are rounded to 64ths of the
greatest, so a source has at most 64 classes; by default a text weighs 1 from
100 words on, and down to a half below.

Only built-in functions run. Ranks are summed in buckets of the rank, and
only the rows of the bucket of the cut are ordered, so a source that holds most rows is spread
over all tasks; only per-source rows meet in one task.

Defined results: null sources are one source, last in order; null and empty
texts have size 0 and take nothing; repeated rows (equal ids in one source)
stand or fall together; an empty table gives an empty mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import Scratch, fresh, uniform, word_count

#: Fixed values of the production mix: weights by source order, repeating; the
#: share of all words; the most copies of a source's words.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKETS = 4096


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows with ``source`` and ``size``."""
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights)))))
    per = per.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn(
        "level",
        (share * F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # Levels rise up to the first source that is not full and fall after it.
    water = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    return per.withColumn("water", water).select(
        "source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target")
    )


def by_size(size: Column) -> Column:
    """The weight of a text: a half for none, 1 from 100 words on."""
    return 0.5 + F.least(size, F.lit(100)) / F.lit(200.0)


def rated(sized: DataFrame, most: int = MOST, **parameters) -> DataFrame:
    """(source, weight, source_size, target, copies, odds, left) of each class
    of documents of a source: the whole copies, the inclusion odds, and the
    words left to draw in the whole source."""
    t = targets(sized, most=most, **parameters)
    classes = sized.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words"))
    falling = Window.partitionBy("source").orderBy(F.col("weight").desc())
    above = falling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    mass = F.col("weight") * F.col("words")
    got = t.withColumnRenamed("source", "s").join(classes, F.col("s").eqNullSafe(F.col("source")))
    level = (F.col("target") - float(most) * F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double")) / (F.sum(mass).over(every) - F.coalesce(F.sum(mass).over(above), F.lit(0.0)))
    got = got.withColumn("level", level)
    # The first level at which its own class is not full; none if all are.
    level = F.max(F.when(F.col("level") * F.col("weight") <= most, F.struct("weight", "level"))).over(every)["level"]
    got = got.withColumn("mean", F.coalesce(F.least(F.lit(float(most)), level * F.col("weight")), F.lit(float(most))))
    got = got.withColumn("copies", F.floor("mean").cast("long")).withColumn("p", F.col("mean") - F.floor("mean"))
    got = got.withColumn("odds", F.col("p") / (1.0 - F.col("p"))).withColumn("left", F.col("target") - F.sum(F.col("copies") * F.col("words")).over(every))
    return got.select("source", "weight", "source_size", "target", "copies", "odds", "left")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, weight) of every row, as a written table: the
    texts are read for it once and what follows reads it instead."""
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *([] if weight is None else [weight.alias("w")]))
    sized = sized.select("doc_id", "source", "size", _rounded(by_size(F.col("size")) if weight is None else F.col("w")).alias("weight"))
    return Scratch(docs.sparkSession, "mixing").table(sized, "sizes")


def _rounded(weight: Column) -> Column:
    return F.greatest(F.least(F.ceil(F.coalesce(weight, F.lit(0.0)) * 64), F.lit(64)), F.lit(1)) / F.lit(64.0)


def plan(sized: DataFrame, seed: int = 11, **parameters) -> DataFrame:
    """The cut of each source, for each of its classes: (source, weight,
    source_size, target, copies, odds, cut), where ``cut`` is the highest rank
    drawn, null if none is."""
    rates = Scratch(sized.sparkSession, "mixing").table(rated(sized, **parameters), "rates")
    named = rates.withColumnRenamed("source", "s").withColumnRenamed("weight", "w")
    drawn = _beside(sized, named, {"source": "s", "weight": "w"}).where("odds > 0 and size > 0").select("source", "left", "size", uniform(F.col("doc_id"), seed=seed).alias("u"), "odds")
    # Rows of equal rank are one unit: they stand or fall together. Buckets follow
    # the logarithm of the rank: logit(u) has a density of a quarter at most, so a
    # bucket holds at most about 1/BUCKETS of any class, however small its odds.
    rank = drawn.withColumn("rank", F.col("u") / (1.0 - F.col("u")) / F.col("odds")).withColumn("b", F.floor(F.ln("rank") * (BUCKETS / 4)))
    filled = rank.groupBy("source", "b").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select(F.col("source").alias("s"), F.col("b").alias("c"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), "left").where("start <= left")
    # The last bucket that starts before the target holds the cut, or else the
    # one before it, whose last unit ends within the target. Only these are ordered.
    last = F.row_number().over(Window.partitionBy("s").orderBy(F.col("c").desc()))
    starts = Scratch(sized.sparkSession, "mixing").table(starts.withColumn("last", last).where("last <= 2").select("s", "c", "start", "left"), "starts")
    unit = _beside(rank.drop("left"), starts, {"source": "s", "b": "c"}).groupBy("source", "b", "rank", "start", "left").agg(F.sum("size").alias("size"))
    within = Window.partitionBy("source", "b").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = unit.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    cuts = placed.where(F.col("start") + F.col("inner") + F.col("size") / 2.0 <= F.col("left")).groupBy("source").agg(F.max("rank").alias("cut"))
    cuts = cuts.select(F.col("source").alias("s"), "cut")
    got = rates.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "weight", "source_size", "target", "copies", "odds", "cut")
    return Scratch(sized.sparkSession, "mixing").table(got, "cuts")


def _beside(rows: DataFrame, per_class: DataFrame, names: dict[str, str], most_bytes: int = 4 << 20, salts: int = 32, how: str = "inner") -> DataFrame:
    """Rows joined with what is known of their class (``names``: columns of the
    rows and of the classes). That side is broadcast if its measured size allows
    it; else its rows are repeated for each salt, so that the rows of a large
    source meet it in several tasks."""
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in names.values()]
    n, wide = per_class.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    on = lambda a, b: reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in names.items()])
    if wide + 64 * n <= most_bytes:
        return rows.join(F.broadcast(per_class), on(rows, per_class), how)
    salt, deal = fresh([*rows.columns, *per_class.columns], "_salt"), fresh([*rows.columns, *per_class.columns], "_deal")
    salted = per_class.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn(deal, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return dealt.join(salted, on(dealt, salted) & (F.col(deal) == F.col(salt)), how).drop(salt, deal)


def _taken(rows: DataFrame, cuts: DataFrame, key: str, names: dict[str, str], prefix: str, seed: int) -> DataFrame:
    """The rows with ``<prefix>copies``, how often a row with words is taken,
    and the other columns of its class."""
    cuts = cuts.select(*[F.col(c).alias(f"{prefix}{c}") for c in cuts.columns])
    odds = F.col(f"{prefix}odds")
    u = uniform(F.col(key), seed=seed)
    drawn = F.coalesce(((odds > 0) & (u / (1.0 - u) / odds <= F.col(f"{prefix}cut"))).cast("long"), F.lit(0))
    return _beside(rows, cuts, {a: f"{prefix}{b}" for a, b in names.items()}).withColumn(f"{prefix}copies", F.col(f"{prefix}copies") + drawn)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, weight: Column | None = None, **parameters) -> DataFrame:
    """The mixed rows: each document as often as it is taken."""
    cuts = plan(sizes(docs, key, text, source, weight), seed, **parameters)
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    own = f"{prefix}own"
    weighed = docs.where(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")) != "").withColumn(own, _rounded(by_size(word_count(F.col(text))) if weight is None else weight))
    taken = _taken(weighed, cuts, key, {source: "source", own: "weight"}, prefix, seed)
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(f"{prefix}copies").cast("int"))).alias(own)).drop(own)


def report(docs: DataFrame, seed: int = 11, **parameters) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    sized = sizes(docs)
    cuts = plan(sized, seed, **parameters)
    some = _taken(sized.where("size > 0"), cuts, "doc_id", {"source": "source", "weight": "weight"}, "m_", seed)
    some = some.select("doc_id", "size", F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_copies") * F.col("size")).alias("taken"))
    # Rows without words belong to no class; a source of such rows alone has size and target 0.
    per = cuts.select(F.col("source").alias("s"), "source_size", "target").distinct()
    none = _beside(sized.where("size = 0"), per, {"source": "s"}, how="left")
    none = none.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


#: DuckDB SQL for ``report`` over the view documents.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM per
), levels AS (
  SELECT *, cap / weight AS full_at,
    (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS water FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM water
), weights AS (
  SELECT *, ceil((0.5::DOUBLE + least(size, 100) / 200.0::DOUBLE) * 64) / 64.0::DOUBLE AS w FROM sized
), classes AS (
  SELECT source, w, sum(size)::BIGINT AS words FROM weights WHERE size > 0 GROUP BY source, w
), stands AS (
  SELECT c.*, t.target, (t.target - 2.0::DOUBLE * coalesce(sum(words) OVER f, 0)::DOUBLE) / (sum(w * words) OVER e - coalesce(sum(w * words) OVER f, 0)) AS stand
  FROM classes c JOIN targets t ON t.source IS NOT DISTINCT FROM c.source
  WINDOW f AS (PARTITION BY c.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY c.source)
), means AS (
  SELECT *, coalesce(least(2.0::DOUBLE, w * max_by(stand, CASE WHEN stand * w <= 2 THEN w END) OVER (PARTITION BY source)), 2.0::DOUBLE) AS mean FROM stands
), odds AS (
  SELECT source, w, floor(mean)::BIGINT AS copies, (mean - floor(mean)) / (1 - (mean - floor(mean))) AS odds,
    target - sum(floor(mean)::BIGINT * words) OVER (PARTITION BY source) AS rest FROM means
), ranked AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, o.copies, o.odds, o.rest,
    (('0x' || substr(md5('11:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM weights s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN odds o ON s.source IS NOT DISTINCT FROM o.source AND s.w = o.w AND s.size > 0
), summed AS (
  SELECT *, sum(CASE WHEN odds > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY u / (1 - u) / nullif(odds, 0) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM ranked
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN (copies + CASE WHEN odds > 0 AND coalesce(ahead, 0) + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size ELSE 0 END::BIGINT AS taken
FROM summed
"""

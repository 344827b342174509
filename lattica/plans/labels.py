"""An index of labels: which labels a text may mean.

``postings`` has a row for each run of one to three code points (gram) of each
label, stored by a hash of the gram, so a text is looked for in the labels of its
rarest gram, whose bucket alone is read, and not in all. ``frequencies`` says how
rare a gram is. For the other direction, labels inside a text, ``exact`` stores
the labels by their first two code points: a text reads the buckets of its own
pairs. A table of texts joins the labels on equality with their substrings and
with its own.
No text ever meets all labels, but for the empty one, which all labels contain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of the longest gram, and buckets that grams and labels are dealt to.
GRAM, BUCKETS = 3, 64

POSTINGS = "gram string, node string, label string, lang string, person boolean, bucket long"
FREQUENCIES = "gram string, n long, bucket long"
EXACT = "node string, label string, lang string, person boolean, bucket long"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS))


def _runs(text: Column, size: int | Column) -> Column:
    """The distinct runs of ``size`` code points of a text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


@dataclass(frozen=True)
class LabelIndex:
    postings: DataFrame
    frequencies: DataFrame
    exact: DataFrame

    @classmethod
    def of(cls, labels: DataFrame, persons: DataFrame) -> LabelIndex:
        """From labels (node, label, lang) and the nodes of persons (node)."""
        people = persons.select(F.col("node").alias("_p")).distinct()
        said = labels.join(people, F.col("node") == F.col("_p"), "left").select("node", "label", "lang", F.col("_p").isNotNull().alias("person"))
        grams = F.flatten(F.array(*[_runs(F.col("label"), size) for size in range(1, GRAM + 1)]))
        postings = said.select(F.explode(grams).alias("gram"), "node", "label", "lang", "person").withColumn("bucket", _bucket(F.col("gram")))
        counted = postings.groupBy("gram").agg(F.count("*").alias("n")).withColumn("bucket", _bucket(F.col("gram")))
        return cls(postings, counted, said.withColumn("bucket", _bucket(F.left("label", F.lit(2)))))

    def write(self, path: str) -> None:
        for name, order in (("postings", "gram"), ("frequencies", "gram"), ("exact", "label")):
            # A bucket goes to as many tasks, and files, as its bytes need: common grams and beginnings make large ones.
            dealt = getattr(self, name).hint("rebalance", "bucket")
            dealt.sortWithinPartitions("bucket", order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LabelIndex:
        return cls(*[spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in (("postings", POSTINGS), ("frequencies", FREQUENCIES), ("exact", EXACT))])

    # --- one text ------------------------------------------------------------------

    def _rarest(self, text: str) -> str | None:
        """The gram of a text that fewest labels have; None if one has none."""
        size = min(GRAM, len(text))
        grams = sorted({text[i : i + size] for i in range(len(text) - size + 1)})
        known = self.frequencies.where(F.col("bucket").isin(*[_bucket(F.lit(g)) for g in grams]) & F.col("gram").isin(grams))
        found = known.select("gram", "n").collect()  # a row a gram of the text
        return min(found, key=lambda r: (r.n, r.gram)).gram if len(found) == len(grams) else None

    def matching(self, text: str, both_ways: bool, persons: bool) -> DataFrame:
        """(node, label, lang): the labels that contain a text or, both ways,
        that it contains."""
        columns = ["node", "label", "lang", "person"]
        if not text:
            found = self.exact.select(columns)
        else:
            gram = self._rarest(text)
            hit = F.lit(False) if gram is None else (F.col("bucket") == _bucket(F.lit(gram))) & (F.col("gram") == gram) & F.col("label").contains(text)
            found = self.postings.where(hit).select(columns)
            if both_ways:
                starts = sorted({""} | {text[i : i + k] for i in range(len(text)) for k in (1, 2)})
                inside = F.col("bucket").isin(*[_bucket(F.lit(s)) for s in starts]) & F.lit(text).contains(F.col("label")) & (F.col("label") != text)
                found = found.unionByName(self.exact.where(inside).select(columns))
        return (found.where("person") if persons else found).select("node", "label", "lang")

    # --- a table of texts ----------------------------------------------------------

    def asked(self, texts: DataFrame) -> DataFrame:
        """(text, node, label, lang, person, forward) for a table of distinct
        texts (text): the labels that contain a text (forward), and those that
        it contains. The joins are on substrings, so each is an equality."""
        columns = ["text", "node", "label", "lang", "person"]
        size, long = F.length("text"), F.length("label")
        longest = self.exact.agg(F.max(long).alias("n")).first().n or 0
        # As many numbers as labels have code points at most. A text meets only labels that hold it:
        # by a gram, names that share their grams would all meet.
        sizes = sorted(r.n for r in texts.where((size > 0) & (size <= longest)).select(size.alias("n")).distinct().collect())
        held = F.flatten(F.transform(F.lit(sizes).cast("array<int>"), lambda n: _runs(F.col("label"), n)))
        found = self.exact.select(*columns[1:], F.explode(held).alias("text")).join(texts.where(size > 0), "text").select(columns)
        # All labels contain the empty text, of which there is one at most.
        none = texts.where(F.length("text") == 0).select("text", F.lit(True).alias("_all"))
        every = self.exact.withColumn("_all", F.lit(True)).join(none, "_all").select(columns)
        # A part of a text is looked for only if a label begins like it and is as long.
        starts = self.exact.groupBy(F.left("label", F.lit(2)).alias("start")).agg(F.collect_set(long).alias("sizes"))
        at = F.col("i")
        parts = texts.where(size > 0).select("text", F.explode(F.sequence(F.lit(1), size)).alias("i"))
        begun = F.array_distinct(F.array(F.substr("text", at, F.lit(2)), F.substr("text", at, F.lit(1)), F.lit("")))
        parts = parts.select("text", "i", F.explode(begun).alias("start")).join(starts, "start").select("text", "i", F.explode("sizes").alias("n")).where(at + F.col("n") - 1 <= size)
        # The text itself is found above; the empty label is inside every text.
        parts = parts.select("text", F.substr("text", at, F.col("n")).alias("label")).where(F.col("label") != F.col("text")).distinct()
        inside = self.exact.join(parts.withColumn("bucket", _bucket(F.left("label", F.lit(2)))), ["bucket", "label"]).select(columns)
        return found.unionByName(every).withColumn("forward", F.lit(True)).unionByName(inside.withColumn("forward", F.lit(False)))

"""Packing into optimal length buckets.

A text of n words becomes pieces of at most ``max_len`` words (all full but
the last), so lengths form a histogram of at most ``max_len`` bars, counted
over all rows. Dynamic programming over that histogram finds the ``buckets``
upper bounds that minimise padding, which every piece is padded up to; inside
a bucket, batches of floor(token_budget / bound) pieces form. Pieces are
ordered by a hash inside a bucket; ranks are prefix sums of counts per block
of pieces, so a bucket that holds most rows is spread over all tasks and
leaves one unfilled batch only.

Defined results: null and empty texts have one piece of 0 words (bucket
bound of the smallest bucket); repeated rows each get their own pieces; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import Scratch, shuffle_partitions, word_count

MAX_LEN = 2048
BUCKETS = 16
TOKEN_BUDGET = 65_536


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds that minimise the padding of the histogram, ascending;
    the last is the greatest length. Exact: O(buckets * lengths^2), vectorised."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if n == 0:
        return []
    k = min(buckets, n)
    total = np.concatenate([[0], np.cumsum(c)])
    # cost of a bucket (i, j] is x[j-1] * (total[j] - total[i]) less the words, which are constant
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    came = np.zeros((k + 1, n + 1), np.int64)
    for b in range(1, k + 1):
        new = np.full_like(best, np.iinfo(np.int64).max // 4)
        for j in range(b, n + 1):
            cost = best[b - 1 : j] + x[j - 1] * (total[j] - total[b - 1 : j])
            at = int(np.argmin(cost))
            new[j], came[b, j] = cost[at], at + b - 1
        best = new
    bounds, j = [], n
    for b in range(k, 0, -1):
        bounds.append(int(x[j - 1]))
        j = int(came[b, j])
    return bounds[::-1]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, first_word, n_tokens) for each piece of each row."""
    n = word_count(F.col(text))
    last = F.greatest(F.ceil(F.col("n") / F.lit(float(max_len))) - 1, F.lit(0)).cast("int")
    # The count is a column of its own first, so that it is made once a row.
    got = docs.select(F.col(key).alias("doc_id"), n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = (F.col("piece") * F.lit(max_len)).cast("long")
    return got.select("doc_id", "piece", first.alias("first_word"), F.least(F.col("n") - first, F.lit(max_len)).alias("n_tokens"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, piece, first_word, n_tokens, bucket, bound, batch, slot, padding)."""
    spark = docs.sparkSession
    # The texts are read once; all that follows reads the table of pieces.
    cut = Scratch(spark, "packing").table(pieces(docs, key, text, max_len), "pieces")
    histogram = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()  # max_len + 1 rows at most
    bounds = optimal_bounds(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    blocks = 4 * shuffle_partitions(spark)
    placed = (
        cut.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))))
        .withColumn("bound", F.get(edges, F.col("bucket")))
        .withColumn("_h", F.xxhash64("doc_id", "piece", "n_tokens"))
        .withColumn("_block", F.pmod(F.col("_h"), F.lit(blocks)))
    )
    counts = placed.groupBy("bucket", "_block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("bucket").alias("_b"), F.col("_block").alias("_k"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("bucket", "_block").orderBy("_h", "doc_id", "piece")
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, (F.col("bucket") == F.col("_b")) & (F.col("_block") == F.col("_k"))).withColumn("_rank", F.col("_rank") + F.col("_start"))
    # Pieces longer than the budget get a batch each.
    per_batch = F.greatest(F.floor(F.lit(token_budget) / F.greatest(F.col("bound"), F.lit(1))), F.lit(1)).cast("long")
    return ranked.select(
        "doc_id", F.col("piece").cast("long").alias("piece"), "first_word", "n_tokens",
        F.col("bucket").cast("long").alias("bucket"), "bound",
        F.floor(F.col("_rank") / per_batch).cast("long").alias("batch"),
        F.pmod(F.col("_rank"), per_batch).alias("slot"),
        (F.col("bound") - F.col("n_tokens")).alias("padding"),
    )

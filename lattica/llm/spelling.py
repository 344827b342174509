"""Spelling variants: words one edit apart, and the common form of each.

A dictionary is held in two orders, forwards and by the reversed words. Words
that begin with the first i code points of a word are an interval of the first
order, and words that end with its last s code points one of the second. For
each edit position the two intervals are intersected: the words in both differ
from the word in that place alone. The intersection is two-dimensional range
reporting: a wavelet tree over the permutation between the two orders gives all
points of a rectangle in a number of steps that follows its results and the
logarithm of the dictionary, whatever the size of the intervals. A tree holds
the words of one length, so a replaced code point is a search among words of
equal length and an inserted one among words one longer; deletions are those
seen from the other side. Intervals come from the lengths of common prefixes of
neighbours in an order, for all words of a position at once, and positions
beyond the longest common prefix are left out, as nothing can meet there.

The dictionary is never in one place. Two words one edit apart agree in about
the first or about the last half of their code points, according to the place of
the edit, so each word goes to the trees of its half: six copies (replacement,
longer and shorter partner, each by prefix and by suffix), dealt by the half.
Halves that hold more than ``BLOCK`` code points are split into blocks: their
words are points of one block and ask in all of them, so that no link is lost
and no task holds more; g such words cost g^2 / BLOCK questions. Partitions
follow the code points of the dictionary.

Defined results: null and empty texts have no words, a null id is '' in the
hash; repeated rows count as often as they stand; no words give no rows. Words
may be of any length. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, give_back, groups, shuffle_partitions

#: Fixed values of the production run: the least code points of a word and its
#: least occurrences; one in how many runs loses a code point; how many times a
#: form is as frequent as its variant.
LEAST, SEEN, EVERY, TIMES = 7, 2, 31, 10

#: Code points of words in a tree's task.
BLOCK = 1 << 20

_LARGE, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counts(docs: DataFrame, least: int = LEAST, seen: int = SEEN, every: int = EVERY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts. Shorter runs never become words, so
    the pattern leaves them out."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _LARGE, _SMALL)
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{least},}}+"), F.lit(0))
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("run"))
    each = each.select("run", F.crc32(F.concat_ws(":", "_id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def _copies(words: DataFrame) -> DataFrame:
    """(length, kind, back, key, ask, point, word, n): the copies of a word.

    ``length`` is that of the shorter word of a pair and ``kind`` how much longer
    the other is; ``back`` is 0 where pairs agree in the first half. An edit at
    place i leaves i code points before it: from the half on they share the key
    in front, and below it the key at the end."""
    size = F.length("word")

    def copy(kind: int, back: int, shorter: Column, ask: bool, point: bool) -> Column:
        half = F.floor((shorter + kind) / 2).cast("int")
        tail = shorter - half + kind
        mine = F.right("word", tail) if back else F.left("word", half)
        return F.struct(shorter.alias("length"), F.lit(kind).alias("kind"), F.lit(back).alias("back"), mine.alias("key"), F.lit(ask).alias("ask"), F.lit(point).alias("point"))

    made = [copy(0, back, size, True, True) for back in (0, 1)] + [copy(1, back, size, True, False) for back in (0, 1)] + [copy(1, back, size - 1, False, True) for back in (0, 1)]
    return words.select("word", "n", F.explode(F.array(*made)).alias("c")).select("c.*", "word", "n")


def near(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, both ways."""
    made = _copies(words)
    half = ["length", "kind", "back", "key"]
    per = made.groupBy(*half).agg(F.sum(F.length("word")).alias("points"))
    # At most (copies of the dictionary) / block rows.
    large = scratch.table(per.where(F.col("points") > block).select(*[F.col(c).alias(f"_{c}") for c in half], F.ceil(F.col("points") / block).cast("int").alias("blocks")), "large")
    same = [F.col(c) == F.col(f"_{c}") for c in half]
    split = made.join(large, same, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    asked = F.when(F.col("ask"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = split.withColumn("block", F.explode(asked)).withColumn("point", F.col("point") & (F.col("block") == F.col("own")))
    tree = (F.col("length").cast("long") * 4 + F.col("kind") * 2 + F.col("back")) + F.col("block").cast("long") * (1 << 36)
    points = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(1, min(shuffle_partitions(words.sparkSession), points // 20_000), 6 * points // block)
    ready = dealt.select(tree.alias("tree"), "word", "n", "ask", "point", *half[:1], "key").repartition(parts, "tree", "key").sortWithinPartitions("tree").drop("length", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, rows in groups(batches):
            code &= (1 << 36) - 1
            names, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
            asks, points = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("ask", "point"))
            for a, b in one_edit(names, asks, points, code >> 2, code >> 1 & 1, bool(code & 1)):
                if code >> 1 & 1:
                    a, b = np.concatenate([a, b]), np.concatenate([b, a])
                for at in range(0, len(a), 50_000):
                    x, y = a[at : at + 50_000], b[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in x]), pa.array([names[i] for i in y]), pa.array(n[y], pa.int64())], ["word", "near", "near_n"])
        give_back()

    return ready.mapInArrow(run, "word string, near string, near_n long")


class WaveletTree:
    """The points (i, values[i]) of a permutation, a bit of the values a level,
    the highest first; at each level zeros come before ones, in order."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        bits = max(1, int(len(values) - 1).bit_length())
        for level in range(bits - 1, -1, -1):
            ones = (values >> level & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((1 << level, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all points of rectangles [a, b) x [c, d)."""
        who, low = np.arange(len(a)), np.zeros(len(a), np.int64)
        for width, zeros in self.levels:
            za, zb = zeros[a], zeros[b]
            left = (za < zb) & (c < low + width) & (d > low)
            oa, ob = zeros[-1] + a - za, zeros[-1] + b - zb
            right = (oa < ob) & (c < low + 2 * width) & (d > low + width)
            join = lambda x, y: np.concatenate([x[left], y[right]])  # noqa: B023, E731
            who, a, b, low, c, d = join(who, who), join(za, oa), join(zb, ob), join(low, low + width), join(c, c), join(d, d)
        return who, low


def _order(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, order, common): a row a word, the words in order, and the
    common prefix of each neighbour pair of the order."""
    text = np.array(words, dtype=f"U{width}")
    order = np.argsort(text, kind="stable")
    codes = text.view(np.uint32).reshape(len(words), width)
    differ = codes[order[1:]] != codes[order[:-1]]
    return codes, order, np.where(differ.any(axis=1), differ.argmax(axis=1), width)


class _Intervals:
    """The intervals of an order that share a prefix with each word, counted in
    points."""

    def __init__(self, order: np.ndarray, common: np.ndarray, points: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.common, self.most = common, int(common.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(points[order])])

    def of(self, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.concatenate([[0], np.flatnonzero(self.common < prefix) + 1, [len(self.rank)]])
        at = np.searchsorted(edges, self.rank, "right")
        return self.before[edges[at - 1]], self.before[edges[at]]


def one_edit(words: list[str], asks: np.ndarray, points: np.ndarray, length: int, longer: int, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asking word, point) by number. Asking words have ``length`` code
    points and points ``longer`` (0 or 1) more; edits are looked for from the
    half on, or below it."""
    if len(words) < 2 or not asks.any() or not points.any():
        return
    width = length + longer
    codes, order, common = _order(words, width)
    front = _Intervals(order, common, points)
    _, order_back, common_back = _order([w[::-1] for w in words], width)
    end = _Intervals(order_back, common_back, points)
    held = order[points[order]]
    tree = WaveletTree(end.before[end.rank[held]])
    by_end = order_back[points[order_back]]
    half = (length + longer) // 2
    first, last = (0, half - 1) if back else (half, length - 1 + longer)
    for i in range(first, last + 1):
        rest = length - 1 - i + longer
        if i > front.most or rest > end.most:
            continue
        (a, b), (c, d) = front.of(i), end.of(rest)
        least = 1 + points  # a word that is a point meets itself
        ready = np.flatnonzero(asks & (b - a >= least) & (d - c >= least))
        if not len(ready):
            continue
        who, value = tree.report(a[ready], b[ready], c[ready], d[ready])
        x, y = ready[who], by_end[value]
        # Of the places at which one code point may have been put in, the last.
        keep = x != y if not longer else np.full(len(x), True) if i == length else codes[y, i] != codes[x, i]
        yield x[keep], y[keep]


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form: the form at the end of the chain. A
    chain's steps grow by a factor, so its length is bounded by a logarithm, and
    each round doubles the steps taken."""
    now, turn = scratch.table(links.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        turn += 1
        now = scratch.table(now.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), f"roots-{turn}")
        if not now.agg(F.max("moved")).first()[0]:
            return now.select("word", "root")


def forms(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct
    words: the near word that is most frequent, if ``times`` as frequent."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.table(words.select("word", "n"), "words")
    best = near(words, scratch, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best"))
    joined = words.join(best.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    stands = -F.col("best.less") >= times * F.col("n")
    told = joined.select("word", F.when(stands, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, -F.col("best.less")).alias("form_n"))
    told = scratch.table(told, "forms")
    ends = roots(told.where("form is not null"), scratch).withColumnRenamed("word", "_w")
    return told.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = LEAST, seen: int = SEEN, every: int = EVERY, times: int = TIMES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts with their forms."""
    return forms(counts(docs, least, seen, every, key, text), times)

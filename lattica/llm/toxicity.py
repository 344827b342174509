"""Toxicity by gradient-boosted trees over dense features, calibrated.

Features of a text: densities and strengths of lexicon hits (a fixed English
list, and words and word beginnings learned from labelled rows), how near a
second-person pronoun stands to a hit, rates of capitals, of punctuation and of
obfuscated or stretched words, and hits once the disguise is undone. Boosted
trees of bounded depth are fitted on second-order gradients of the log loss
over binned features; isotonic regression of out-of-fold scores makes them
probabilities.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash
of their id (the documented bound of the classifier); word counts of the
sample are made in parallel, and the driver sees only the kept lexicon entries
and one dense row a sampled document. Lexicons are learned on one half of the
sample to make the features of the other, so no row is scored by its own
label. Every text is scored, whole, where it is read.

Defined results: null and empty texts have zero features and get the score of
such a text; repeated labels of an id count once (toxic wins); null labels are
none; without rows of both classes the score is 0.9 with a word of the fixed
list and 0.05 without; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, give_back, rows_of

SAMPLE = 24_000
ENTRIES = 6_000

#: Abusive words, second-person pronouns of four languages, and
#: the signs that stand for letters in disguised words.
ABUSIVE = frozenset("""
    idiot idiots moron morons stupid dumb dumbass fool loser losers pathetic worthless trash garbage scum filth vermin
    disgusting clown imbecile cretin retard retarded bastard bitch asshole jerk pig swine freak creep ugly coward liar
    shit shitty fuck fucking fucker crap damn hate kill die hell whore slut
""".split())  # fmt: skip
YOU = frozenset("""
    you your yours yourself u ur ya du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos
    tú ti tus usted ustedes vosotros
""".split())  # fmt: skip
LEET = str.maketrans("013457@$!|", "oieastasii")
EDGE = ".,;:!?\"'()[]{}<>*#$%&-_~`|/\\"

_INNER = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_][0-9]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

FEATURES = (
    "words", "fixed", "fixed_rate", "learned", "learned_rate", "learned_sum", "learned_max", "begin", "begin_rate", "begin_max", "kinds",
    "you_rate", "you_near", "capitals", "shouted", "exclaims", "asks", "punctuation", "obfuscated", "stretched", "undone",
)


def entries(word: str) -> list[str]:
    """What a lexicon may hold of a word: itself and its beginnings."""
    bare = word.lower().strip(EDGE)
    return [f"w:{bare}", *[f"p:{bare[:n]}" for n in (4, 5) if len(bare) > n]] if bare else []


class _Seen(dict):
    """What is known of a word; None if nothing is worth a look."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        bare = word.lower().strip(EDGE)
        lexicon = self.lexicon
        learned = lexicon.get(f"w:{bare}", 0.0)
        begin = max([lexicon.get(f"p:{bare[:n]}", 0.0) for n in (4, 5) if len(bare) > n], default=0.0)
        fixed, you = bare in ABUSIVE, bare in YOU
        shouted = len(bare) > 2 and word.isupper()
        odd = bool(_INNER.search(word))
        stretched = bool(_STRETCHED.search(bare))
        undone = False
        if odd or stretched:
            plain = re.sub(r"[^\w]|_", "", bare.translate(LEET))
            plain = re.sub(r"(.)\1{2,}", r"\1", plain)
            undone = plain != bare and (plain in ABUSIVE or f"w:{plain}" in lexicon)
        got = (fixed, learned, begin, you, shouted, odd, stretched, undone, bare) if fixed or learned or begin or you or shouted or odd or stretched else None
        if len(self) < 150_000:
            self[word] = got
        return got


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.seen = _Seen(lexicon)

    def row(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        words = text.split()
        n = max(1, len(words))
        fixed = learned = begin = you = shouted = odd = stretched = undone = 0
        total = top = begin_top = 0.0
        at_hit, at_you, kinds = [], [], set()
        for i, w in enumerate(map(self.seen.__getitem__, words)):
            if w is None:
                continue
            fixed += w[0]
            you += w[3]
            shouted += w[4]
            odd += w[5]
            stretched += w[6]
            undone += w[7]
            if w[1]:
                learned += 1
                total += w[1]
                top = max(top, w[1])
            if w[2]:
                begin += 1
                begin_top = max(begin_top, w[2])
            if w[0] or w[1] or w[2] or w[7]:
                at_hit.append(i)
                kinds.add(w[8])
            if w[3]:
                at_you.append(i)
        near = 0.0
        if at_hit and at_you:
            places = np.array(at_you)
            right = np.searchsorted(places, at_hit)
            far = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at_hit), np.abs(places[np.maximum(right - 1, 0)] - at_hit))
            near = 1.0 / (1.0 + float(far.min()))
        raw = text.encode("utf-8", "replace")
        letters = len(raw) - len(raw.translate(None, _LETTERS))
        capitals = len(raw) - len(raw.translate(None, _UPPER))
        marks = len(raw) - len(raw.translate(None, _PUNCTUATION))
        return [
            math.log1p(len(words)), fixed, fixed / n, learned, learned / n, math.log1p(total), top, begin, begin / n, begin_top, len(kinds),
            you / n, near, capitals / max(1, letters), shouted / n, raw.count(b"!") / n, raw.count(b"?") / n, marks / n, odd / n, stretched / n, undone,
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], float).reshape(-1, len(FEATURES))


# --- boosted trees -----------------------------------------------------------


@dataclass
class Boosted:
    """Trees of equal depth in heap order: an inner node i has children 2i+1
    (value <= cut) and 2i+2."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    ridge: float = 1.0
    least: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base, self.trees = math.log(p / (1 - p)), []
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        # Rare positive values fall above the last quantile; they get edges of their own.
        edges = [np.unique(np.concatenate([e, [x[:, f].min()], np.quantile(v, np.linspace(0, 1, 8)) if len(v := x[x[:, f] > 0, f]) else []])) for f, e in enumerate(edges)]
        width = max(len(e) for e in edges) + 1
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            score += self._grow(x, binned, edges, width, g, h)
        return self

    def _grow(self, x, binned, edges, width, g, h) -> np.ndarray:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, many = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(many, 1e-3)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                place = local * width + binned[:, f]
                gs = np.cumsum(np.bincount(place, g, many * width).reshape(many, width), axis=1)
                hs = np.cumsum(np.bincount(place, h, many * width).reshape(many, width), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = -1
                gain = gain[:, : len(e)]
                top = gain.argmax(axis=1)
                better = gain[np.arange(many), top] > best
                best[better] = gain[np.arange(many), top][better]
                feature[first : first + many][better] = f
                cut[first : first + many][better] = e[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
        self.trees.append((feature, cut, value))
        return value[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - len(feature)]
        return score


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values), both non-decreasing."""
    levels, place = np.unique(score, return_inverse=True)  # equal scores are one point
    total, rows = np.bincount(place, label, len(levels)), np.bincount(place, minlength=len(levels))
    blocks: list[list[float]] = []  # sum of labels, rows, least and greatest score
    for s, t, n in zip(levels.tolist(), total.tolist(), rows.tolist()):
        blocks.append([t, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = [v for b in blocks for v in (b[2], b[3])]
    values = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(knots), np.array(values)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None
    knots: np.ndarray | None
    values: np.ndarray | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.where(x[:, FEATURES.index("fixed")] > 0, 0.9, 0.05)
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0.0, 1.0)


# --- learning and scoring over tables -----------------------------------------


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3))


def _lexicon(rows: DataFrame, most: int) -> dict[str, float]:
    """Log odds of the words and beginnings that mark toxic rows of (text, y)."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1 << 20):
            keys, ys = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {e for w in set((text or "").split()) for e in entries(w)}
                keys += found
                ys += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ys, pa.int32())], ["entry", "y"])
        give_back()

    totals = rows.agg(F.sum("y"), F.count("*")).first()
    bad, good = (totals[0] or 0) + 1.0, (totals[1] or 0) - (totals[0] or 0) + 1.0
    share = bad / (bad + good)
    odds = F.log((F.col("a") + 0.5) / F.lit(bad)) - F.log((F.col("n") - F.col("a") + 0.5) / F.lit(good))
    strength = (F.col("a") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    counted = rows.select("text", "y").mapInArrow(words, "entry string, y int").groupBy("entry").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    kept = counted.where("a >= 3").select("entry", odds.alias("odds"), strength.alias("z")).where("odds > 1.5 and z > 4").orderBy(F.col("z").desc(), "entry").limit(most)
    return {r.entry: float(r.odds) for r in kept.collect()}


def _features(rows: DataFrame, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Featurizer(lexicon)
        for batch in rows_of(batches, 2 << 20):
            x = made.matrix(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])
        give_back()

    got = rows.select("text", "y").mapInArrow(run, "y int, x array<double>").toArrow()
    return np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most: int = ENTRIES) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(fold(F.col(key)) != 1)
    known = known.groupBy(F.col(key).alias("_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    # About twice the sample by a hash, so that what is ordered stays small.
    share = min(1.0, 2.0 * sample / max(1, known.count()))
    likely = known.where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30)) <= share * (1 << 30))
    chosen = likely.orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(sample)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("text", "y", F.pmod(F.xxhash64(F.lit(4), "_id"), F.lit(2)).alias("half"))
    rows = Scratch(spark, "toxicity").table(rows, "sample")
    lexicon = _lexicon(rows, most)
    halves = []
    for half in (0, 1):
        other = _lexicon(rows.where(F.col("half") != half), most)
        halves.append(_features(rows.where(F.col("half") == half), other))
    y = np.concatenate([h[1] for h in halves])
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, None, None)
    order = [np.lexsort(h[0].T) for h in halves]  # whatever the order of the rows, the same model
    halves = [(h[0][o], h[1][o]) for h, o in zip(halves, order)]
    x, y = np.vstack([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
    # Four folds, whatever the order, for the scores that calibrate.
    part, unseen = np.arange(len(y)) % 4, np.zeros(len(y))
    for p in range(4):
        rest = part != p
        unseen[~rest] = Boosted().fit(x[rest], y[rest]).margin(x[~rest])
    knots, values = isotonic(unseen, y)
    return Model(lexicon, Boosted().fit(x, y), knots, values)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows' key and text columns give (doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ENTRIES lexicon entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        made = Featurizer(model.lexicon)
        for batch in rows_of(batches, 2 << 20):
            s = model.scores(made.matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])
        give_back()

    got = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows with scores below ``threshold``, all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        made = Featurizer(model.lexicon)
        for batch in rows_of(batches, 2 << 20):
            s = model.scores(made.matrix(batch.column(at).to_pylist()))
            yield batch.filter(pa.array(s < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)

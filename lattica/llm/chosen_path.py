"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct word shingles; equal sets are one from the
start. ``trees`` independent trees branch the sets: at each node, coordinates
of a MinHash vector are chosen by a hash of the path to it (one, and a second
with probability 1/threshold - 1, so that a pair at the threshold is expected
to share one path at every depth), and a set descends to the child named by
its minwise token there. A node of at most ``small`` sets is compared
exhaustively; larger ones branch on down to ``depth``. A node that is still
large there holds sets that agree in many minwise tokens; it is dealt out in
chunks which all hold its smallest document (its pivot). If that leaves more than
one component in it, its sets meet by their rarest shingles, exactly and in
whatever number (``rare_prefix``), so deeper branching would find nothing more.

Comparison is in two steps: estimates over ``COORDINATES`` 8-bit minwise
tokens (corrected for chance agreement), at a threshold that a pair to be linked
misses with probability below 1e-4, then the exact Jaccard similarity on full
sets. Each set is first
verified against the smallest similar document of its node (a star), then
against the most similar one of another component, and at last every pair
whose ends are still in different components; pairs inside a component would
not change the result, so a group of n copies costs about n verifications in
place of n^2, and none is left out for its size. A pair is verified once.

Defined results: null, empty and blank texts have the empty set and link with
nothing; rows without an id link with nothing; rows that share an id are one
document; fewer words than a shingle are one shingle; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import rare_prefix
from lattica.llm.common import Scratch, components, give_back, rows_of, shuffle_partitions

COORDINATES = 128
TREES = 10
DEPTH = 4
SMALL = 32
CHUNK = 256
BEST = 2


class _Words(dict):
    """64-bit hashes of words; remembers up to a quarter of a million."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 250_000:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and the six white-space characters only
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_words().__getitem__, words)), dtype=np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(_mix(out))


@lru_cache(maxsize=4)
def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]


def minwise(items: np.ndarray, seed: int) -> np.ndarray:
    a, b = _permutations(seed)
    low = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):  # long texts in slices that stay in the cache
        np.minimum(best, (a * low[None, at : at + 2048] + b).min(axis=1), out=best)
    return best


def _hash(*parts: int) -> int:
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ p) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    return x


def paths(sig: list[int], trees: int, depth: int, threshold: float, seed: int) -> list[list[int]]:
    """The keys of the nodes that a set visits, one list of ``depth`` keys for
    each path; the choice at a node depends on its path alone."""
    second = int((1 / threshold - 1) * 2**32)
    found: list[list[int]] = []
    for tree in range(trees):
        live = [(_hash(seed, tree), ())]
        for _ in range(depth):
            grown = []
            for key, before in live:
                chosen = {key % COORDINATES}
                if (key >> 32) < second:
                    chosen.add((key >> 8) % COORDINATES)
                for c in chosen:
                    child = _hash(key, c, sig[c])
                    grown.append((child, (*before, child)))
            live = grown
        found += [list(p) for _, p in live]
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def features(docs: DataFrame, width: int, threshold: float, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, h1, h2, sig, paths) of each row; h1 and h2 name its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n, h1, h2, sigs, walks = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                items = shingles(t, width)
                n.append(len(items))
                if not len(items):
                    for column in (h1, h2, sigs, walks):
                        column.append(None)
                    continue
                raw = items.tobytes()
                h1.append(_signed(xxhash.xxh3_64_intdigest(raw)))
                h2.append(_signed(xxhash.xxh3_64_intdigest(raw, 1)))
                sig = minwise(items, seed)
                folded = sig ^ (sig >> np.uint32(16))
                sigs.append((folded ^ (folded >> np.uint32(8))).astype(np.uint8).tobytes())
                walks.append(np.array(paths(sig.tolist(), TREES, DEPTH, threshold, seed), np.uint64).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(walks, pa.binary())],
                ["doc_id", "n", "h1", "h2", "sig", "paths"],
            )
        give_back()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary, paths binary")


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reps, keys = [], []
        for rep, walk in zip(batch.column(0).to_pylist(), batch.column(1)):
            nodes = np.frombuffer(walk.as_py(), "<i8").reshape(-1, DEPTH)
            reps.append(np.full(len(nodes), rep))
            keys.append(nodes)
        if reps:
            table = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), *[pa.array(np.ascontiguousarray(table[:, d])) for d in range(DEPTH)]], ["rep", *[f"k{d + 1}" for d in range(DEPTH)]])


def leaves(sets: DataFrame, scratch: Scratch, small: int = SMALL, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(leaf, rep) of the nodes that stay small, and (leaf, chunks, pivot, rep)
    of those that are still large at the last depth. Nodes of one set go."""
    names = ", ".join(f"k{d + 1} long" for d in range(DEPTH))
    walking = sets.select("rep", "paths").mapInArrow(_unfold, f"rep long, {names}")
    walking = scratch.table(walking, "walks")
    kept, large = None, None
    for d in range(1, DEPTH + 1):
        k, deeper = f"k{d}", [f"k{x}" for x in range(d + 1, DEPTH + 1)]
        counts = scratch.table(walking.groupBy(k).agg(F.count("*").alias("m"), F.min("rep").alias("pivot")).where("m > 1").withColumnRenamed(k, "leaf"), f"counts{d}")
        placed = walking.join(counts, walking[k] == counts["leaf"])
        some = placed.where(F.col("m") <= small).select("leaf", "rep")
        kept = some if kept is None else kept.unionByName(some)
        more = placed.where(F.col("m") > small)
        if d == DEPTH:
            large = more.select("leaf", F.ceil(F.col("m") / float(chunk)).cast("int").alias("chunks"), "pivot", "rep").distinct()
        else:
            walking = scratch.table(more.select("rep", *deeper), f"walks{d}")
    found = scratch.table(kept.distinct(), "leaves"), scratch.table(large, "large")
    scratch.release("walks", *[f"walks{d}" for d in range(1, DEPTH)], *[f"counts{d}" for d in range(1, DEPTH + 1)])
    return found


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole leaves at a time: (leaf, rep, label, sig), sorted by leaf and rep."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf, rep, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        now = (leaf, rep, label, sig) if held is None else tuple(np.concatenate(x) for x in zip(held, (leaf, rep, label, sig)))
        cut = int(np.searchsorted(now[0], now[0][-1])) if np.all(now[0][:-1] <= now[0][1:]) else len(now[0]) - int(np.argmax((now[0] != now[0][-1])[::-1]))
        if cut:
            yield tuple(x[:cut] for x in now)
        held = tuple(x[cut:] for x in now)
    if held is not None:
        yield held


def _pairs(rows: DataFrame, least: float, mode: str) -> DataFrame:
    """Estimated pairs (a, b) inside the leaves of (leaf, rep, label, sig): for
    each set its smallest similar one or else a larger one (``star``), the most similar one with
    another label (``best``), or all pairs with unequal labels (``all``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf, rep, label, sig in _signatures(batches):
            other, later, top = np.full(len(leaf), -1), np.full(len(leaf), -1), np.full(len(leaf), -1.0)
            for s in range(1, len(leaf)):
                at = np.flatnonzero(leaf[:-s] == leaf[s:])
                if not len(at):
                    break
                if mode != "star":
                    at = at[label[at] != label[at + s]]
                at = at[rep[at] != rep[at + s]]
                for lo in range(0, len(at), 16_384):
                    part = at[lo : lo + 16_384]
                    near = (sig[part] == sig[part + s]).mean(axis=1)
                    good, near = part[near >= least], near[near >= least]
                    if mode == "star":
                        other[good + s] = good  # shifts grow, so the smallest document stays
                        later[good] = good + s
                    elif mode == "best":
                        for mine, its in ((good, good + s), (good + s, good)):
                            up = near > top[mine]
                            top[mine[up]], other[mine[up]] = near[up], its[up]
                    elif len(good):
                        yield pa.RecordBatch.from_arrays([pa.array(rep[good]), pa.array(rep[good + s])], ["a", "b"])
            if mode != "all":
                other = np.where(other < 0, later, other)  # without a smaller one, a larger one
                found = np.flatnonzero(other >= 0)
                ends = rep[other[found]], rep[found]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], ["a", "b"])

    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "leaf").sortWithinPartitions("leaf", "rep")
    return spread.mapInArrow(run, "a long, b long").distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """The rows of (rep, text) whose rep is in (w). Most texts are not wanted, so
    a Bloom filter of one hash, bounded to ``most_bits`` whatever the number of
    documents, drops them before the join; the join decides."""
    bits = 1 << 16
    n = wanted.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = wanted.select(place("w").alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("mask")).toArrow()
    filled = np.zeros(bits >> 6, np.uint64)
    filled[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((mask[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    likely = docs.where("rep is not null").select("rep", "text", place("rep").alias("p")).mapInArrow(run, "rep long, text string, p long").drop("p")
    return likely.join(wanted, F.col("rep") == F.col("w")).drop("w")


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch, name: str, tried: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full
    sets, without those of ``tried``, to which they are added.

    A cell is one document and up to about ``CHUNK`` partners, so a document
    with many partners is spread over several cells; partners stream past it.
    """
    for before in tried:
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    pairs = scratch.table(pairs, f"{name}-pairs")
    if pairs.isEmpty():
        return pairs
    tried.append(pairs)
    many = scratch.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / float(CHUNK)).cast("int").alias("cells")).withColumnRenamed("a", "c"), f"{name}-cells")
    placed = pairs.join(many, F.col("a") == F.col("c")).select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("cells"))).alias("cell"), "a", "b")
    roles = placed.select("cell", F.col("a").alias("rep"), F.lit(0).alias("role")).distinct().unionByName(placed.select("cell", F.col("b").alias("rep"), F.lit(1).alias("role")))
    held = roles.join(texts, "rep").select("cell", "role", "rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, centres = None, []
        for batch in rows_of(batches):
            linked = set()
            for cell, role, rep, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if cell != current:
                    current, centres = cell, []
                items = shingles(text.as_py(), width)
                if role == 0:
                    centres.append((rep, items))
                    continue
                for a, centre in centres:
                    shared = np.intersect1d(centre, items, assume_unique=True).size
                    if shared and 100 * shared >= percent * (len(centre) + len(items) - shared):
                        linked.add((a, rep))
            if linked:
                a, b = zip(*linked)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    spread = held.repartition(shuffle_partitions(pairs.sparkSession), "cell").sortWithinPartitions("cell", "role")
    found = scratch.table(spread.mapInArrow(run, "a long, b long"), f"{name}-links")
    scratch.release(f"{name}-cells")
    return found


def _tokens(sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(rep, token) of the distinct shingles of the sets (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1 << 20):
            items = [shingles(t.as_py(), width) for t in batch.column(1)]
            reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in items])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(items).astype(np.int64))], ["rep", "token"])
        give_back()

    return texts.join(sets, "rep").select("rep", "text").mapInArrow(run, "rep long, token long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "chosen-path")
    threshold = percent / 100
    agree = threshold + (1 - threshold) / 256  # equal tokens, or unequal ones of equal bytes
    least = agree - 4 * (agree * (1 - agree) / COORDINATES) ** 0.5
    seen = scratch.table(features(docs, width, threshold, seed, key, text), "features")
    sets = seen.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    sets = scratch.table(sets, "sets")
    small, large = leaves(sets, scratch, SMALL, CHUNK)
    signed = sets.select(F.col("rep").alias("r"), "sig")

    def with_sig(rows: DataFrame) -> DataFrame:
        return rows.join(signed, F.col("rep") == F.col("r")).select("leaf", "rep", "label", "sig")

    # The star of each node; chunks of large nodes share their pivot.
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    own = large.select(F.xxhash64("leaf", mine).alias("leaf"), "rep")
    pivots = large.select("leaf", "pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    pivots = pivots.select(F.xxhash64("leaf", F.col("o").cast("bigint")).alias("leaf"), F.col("pivot").alias("rep")).distinct()
    rows = small.unionByName(own).unionByName(pivots).distinct().withColumn("label", F.lit(0).cast("long"))
    stars = scratch.table(_pairs(with_sig(rows), least, "star"), "stars")

    wanted = stars.select(F.col("a").alias("w")).unionByName(stars.select(F.col("b").alias("w"))).unionByName(large.select(F.col("rep").alias("w"))).distinct()
    wanted = scratch.table(wanted, "wanted")
    texts = texts_of(docs.select(F.col(key).cast("long").alias("rep"), F.col(text).cast("string").alias("text")), wanted)
    texts = scratch.table(texts, "texts")
    tried: list[DataFrame] = []
    links = verify(stars, texts, width, percent, scratch, "star", tried)
    labels = scratch.table(components(links, scratch), "labels")

    near = wanted.withColumnRenamed("w", "rep")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")

    # The most similar document of another component, in every node: what is
    # left in pieces of a large group by its star grows together here.
    for turn in range(BEST):
        rows = labelled(small.join(near, "rep").unionByName(own)).distinct()
        more = verify(_pairs(with_sig(rows), least, "best"), texts, width, percent, scratch, f"best{turn}", tried)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = scratch.table(components(links, scratch), f"labels{turn}")

    # Large nodes that hold more than one component: their sets meet by rare
    # shingles, first the nearest, which joins the parts of dense groups.
    held = labelled(large).groupBy("leaf").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("leaf")
    held = scratch.table(large.join(held, "leaf").select("rep").distinct(), "apart")
    posted = None
    if not held.isEmpty():
        tokens = scratch.table(_tokens(held, texts, width), "tokens")
        posted = scratch.table(rare_prefix.postings(tokens, sets.select("rep", "n"), percent), "postings")
        scratch.release("tokens")
        for turn in range(BEST):
            more = verify(rare_prefix.nearest(labelled(posted), percent), texts, width, percent, scratch, f"nearest{turn}", tried)
            if more.isEmpty():
                break
            links = links.unionByName(more)
            labels = scratch.table(components(links, scratch), f"joined{turn}")

    # Every estimated pair of a small node whose ends are still apart, and every
    # possible pair of the large ones.
    bridges = _pairs(with_sig(labelled(small.join(near, "rep"))), least, "all")
    if posted is not None:
        bridges = bridges.unionByName(rare_prefix.pairs(labelled(posted), percent)).distinct()
    more = verify(bridges, texts, width, percent, scratch, "bridge", tried)
    whole = components(links.unionByName(more), scratch)

    known = sets.select("h1", "h2", "rep").join(whole, F.col("rep") == F.col("node"), "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("component", "rep").alias("component"))
    known = scratch.table(known, "known")
    scratch.release("texts", "stars", "leaves", "large", "wanted", "apart", "postings")
    mine = seen.select("doc_id", "n", *[F.when(F.col("doc_id").isNotNull(), F.col(h)).alias(h) for h in ("h1", "h2")])
    got = mine.join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return got.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document is the smallest of its component; of rows that
    repeat its id and text one stays. Rows without an id all stay."""
    found = near_duplicates(docs, width, percent, key, text).where("kept").select(F.col("doc_id").alias("_kept")).where("_kept is not null").distinct()
    fine = docs.where(F.col(key).isNotNull()).dropDuplicates([key, text]).join(found, F.col(key) == F.col("_kept")).drop("_kept")
    return fine.select(docs.columns).unionByName(docs.where(F.col(key).isNull()))


#: DuckDB SQL for three-word shingles at 85 percent over the view documents
#: (distinct doc_ids), all pairs that share a shingle compared.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d JOIN smallest m ON m.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

"""Benchmark decontamination by winnowing.

A text is its words. Every window of ten words has six grams of five words; the
gram with the least hash (the first of equals) is the window's fingerprint. Two
equal windows have the same fingerprint at the same place, so every passage of
ten words or more that a document shares with an item shows in a fingerprint
that both keep, while a text keeps about two for seven words. An item of fewer
words is one window with itself as gram; documents then also keep all grams of
that length.

The fingerprints of documents are written once, a row a document, and met with
those of the items. Around the places that stay, the hits are extended to the
windows that hold them, and the windows are compared word by word. A window that
many items share is one row that names the set of its items, so a common phrase
does not multiply documents by items. Equal texts are worked on once from there:
results are kept by the digest of the text and joined to the documents at the
end. Small sides are broadcast by Spark's own check of their size.

Only built-in functions run.

Defined results: null, empty and wordless texts have no words and no hit; null
and empty items have no window; items of equal id are one item with the windows
of all its rows, and null ids are one item named ''. Rows of documents come one
for one, repeated and null ids as well. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch

#: Words in a window, and in a gram.
WINDOW, GRAM = 10, 5

#: What stands between words, and the letters made small.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LARGE, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _LARGE, _SMALL), _BETWEEN), "")


def _least(grams: Column, at: Column, span: int) -> Column:
    """The place of the least gram of the window at ``at``."""
    inside = F.slice(grams, at + 1, span)
    return (at + F.array_position(inside, F.array_min(inside)) - 1).cast("int")


_MARKS = "array<struct<length: int, at: int, h: bigint>>"


def _with_marks(texts: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """Adds ``marks``, an array of (length, at, h): the fingerprints of the
    windows of each length, from ``words``. Each step is a projection of its
    own, so that nothing is computed twice."""
    texts = texts.withColumn("_codes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("marks", F.array().cast(_MARKS))
    for length in lengths:
        texts = _marked(texts, length, gram if length == window else length)
    return texts.drop("_codes")


def _marked(texts: DataFrame, length: int, size: int) -> DataFrame:
    """``marks`` with the fingerprints of the windows of one length added. What
    a lambda looks up by place is a column that is used more than once, which
    Spark doesn't write out inside the lambda."""
    n = F.size("words")
    enough = n >= length
    hashed = lambda codes: F.xxhash64(F.lit(size), *codes)
    if size == 1:
        coded = F.transform("_codes", lambda c: hashed([c]))
    else:
        coded = F.transform(F.sequence(F.lit(0), n - size), lambda i: hashed([F.get(F.col("_codes"), i + d) for d in range(size)]))
    texts = texts.withColumn("_grams", F.when(enough, coded))
    mark = lambda at, h: F.struct(F.lit(length).alias("length"), at.cast("int").alias("at"), h.alias("h"))
    if size == length:
        made = F.transform("_grams", lambda h, i: mark(i, h))
    else:
        least = F.array_distinct(F.transform(F.sequence(F.lit(0), n - length), lambda j: _least(F.col("_grams"), j, length - size + 1)))
        texts = texts.withColumn("_at", F.when(enough, least))
        made = F.transform("_at", lambda p: mark(p, F.get(F.col("_grams"), p)))
    return texts.withColumn("marks", F.when(enough, F.concat("marks", made)).otherwise(F.col("marks"))).drop("_grams", "_at")


class Items:
    """The windows of the benchmark's items, as written tables.

    ``windows``: (length, code, body, kind), each distinct window once;
    ``kinds``: (kind, sets), the sets of items that share windows, as ids of
    ``texts``; ``texts``: (item, ids), the ids of the items of one text;
    ``grams``: (h), the fingerprints kept."""

    def __init__(self, benchmark: DataFrame, scratch: Scratch, window: int, gram: int, key: str = "item_id", text: str = "text"):
        self.window, self.gram = window, gram
        named = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
        # Copies of an item are one text with several ids.
        texts = named.groupBy("words").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("item", F.monotonically_increasing_id())
        self.texts = scratch.table(texts, "items")
        sized = self.texts.withColumn("length", F.least(F.size("words"), F.lit(window)))
        self.lengths = sorted(r.length for r in sized.select("length").distinct().collect())  # at most ``window`` of them
        each = sized.select("item", "length", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
        bodies = each.select("item", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("body"))
        shared = bodies.groupBy("length", "body").agg(F.sort_array(F.collect_set("item")).alias("sets"))
        shared = scratch.table(shared.withColumn("code", F.xxhash64("body")), "shared")
        self.kinds = scratch.table(shared.select("sets").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
        self.windows = shared.join(self.kinds, "sets").select("length", "code", "body", "kind")
        marked = _with_marks(self.texts.select("words"), self.lengths, window, gram)
        # A text keeps fingerprints of its own length only: shorter ones are other items.
        own = F.filter("marks", lambda m: m["length"] == F.least(F.size("words"), F.lit(window)))
        self.grams = scratch.table(marked.select(F.explode(own).alias("m")).select("m.h").distinct(), "grams")


def _covered(spans: Column) -> Column:
    """The number of words inside spans (at, length)."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def add(so_far: Column, s: Column) -> Column:
        end = s["at"] + s["length"]
        return F.struct(F.greatest(so_far["reach"], end).alias("reach"), (so_far["n"] + F.greatest(F.lit(0), end - F.greatest(so_far["reach"], s["at"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda a: a["n"])


def _documents(docs: DataFrame, items: Items, scratch: Scratch, key: str, text: str) -> DataFrame:
    """(doc_id, digest, n_words, marks) of every row, as a written table."""
    split = docs.select(F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), words(F.col(text)).alias("words"))
    marked = _with_marks(split, items.lengths, items.window, items.gram)
    return scratch.table(marked.select("doc_id", F.unhex("digest").alias("digest"), F.size("words").cast("long").alias("n_words"), "marks"), "documents")


def _found(docs: DataFrame, marked: DataFrame, items: Items, scratch: Scratch, text: str) -> DataFrame:
    """(digest, length, at, kind): the windows of texts that are windows of
    items, as a written table."""
    each = marked.select("digest", F.explode("marks").alias("m")).select("digest", "m.*").join(items.grams, "h", "left_semi")
    places = scratch.table(each.groupBy("digest").agg(F.collect_set(F.struct("length", "at")).alias("places")), "places")
    # The windows that can have their fingerprint at a place: those that hold it.
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("digest"), F.col(text).alias("text")).join(places, "digest")
    texts = texts.select("digest", "places", words(F.col("text")).alias("words")).withColumn("_n", F.size("words"))

    def around(p: Column) -> Column:
        span = F.when(p["length"] == items.window, F.lit(items.window - items.gram)).otherwise(F.lit(0))
        starts = F.sequence(F.greatest(F.lit(0), p["at"] - span), F.least(p["at"], F.col("_n") - p["length"]))
        return F.transform(starts, lambda j: F.struct(p["length"].alias("length"), j.alias("at")))

    texts = texts.withColumn("_windows", F.array_distinct(F.flatten(F.transform("places", around))))
    opened = F.transform("_windows", lambda w: F.struct(w["length"].alias("length"), w["at"].alias("at"), F.slice(F.col("words"), w["at"] + 1, w["length"]).alias("body")))
    mine = texts.select("digest", opened.alias("w")).select("digest", F.explode("w").alias("w")).select("digest", "w.*").withColumn("code", F.xxhash64("body"))
    theirs = items.windows.select(F.col("length").alias("_l"), F.col("code").alias("_c"), F.col("body").alias("_b"), "kind")
    hit = mine.join(theirs, (F.col("code") == F.col("_c")) & (F.col("length") == F.col("_l")) & (F.col("body") == F.col("_b")))
    # Rows of equal texts say the same.
    return scratch.table(hit.select("digest", "length", "at", "kind").distinct(), "found")


def _ready(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, key: str, text: str) -> tuple[Items, DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "winnowing")
    items = Items(benchmark, scratch, window, gram)
    marked = _documents(docs, items, scratch, key, text)
    return items, marked, _found(docs, marked, items, scratch, text)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row a
    document. A word is hit if it is inside any window of an item."""
    items, marked, found = _ready(docs, benchmark, window, gram, key, text)
    covered = found.groupBy("digest").agg(F.collect_set(F.struct("at", "length")).alias("spans")).select("digest", _covered(F.col("spans")).cast("long").alias("n_hit"))
    kinds = found.select("digest", "kind").distinct().join(items.kinds, "kind")
    named = kinds.select("digest", F.explode("sets").alias("item")).distinct().join(items.texts.select("item", "ids"), "item")
    listed = named.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    results = covered.join(listed, "digest").select("digest", "n_hit", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("joined"))
    whole = marked.select("doc_id", "digest", "n_words").join(results, "digest", "left")
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, n_windows): the passages that documents share with
    items, by word, end exclusive; windows that overlap are one passage."""
    _, marked, found = _ready(docs, benchmark, window, gram, key, text)
    spans = F.array_sort(F.collect_set(F.struct("at", F.col("length").alias("size"))))
    empty = F.array().cast("array<struct<start: int, end: int, n_windows: int>>")

    def join(so_far: Column, s: Column) -> Column:
        last, end = F.element_at(so_far, -1), s["at"] + s["size"]
        one = lambda start, stop, n: F.array(F.struct(start.alias("start"), stop.alias("end"), n.alias("n_windows")))
        grown = F.concat(F.slice(so_far, F.lit(1), F.size(so_far) - 1), one(last["start"], F.greatest(last["end"], end), last["n_windows"] + 1))
        return F.when((F.size(so_far) > 0) & (s["at"] <= last["end"]), grown).otherwise(F.concat(so_far, one(s["at"], end, F.lit(1))))

    runs = found.groupBy("digest").agg(spans.alias("s")).select("digest", F.aggregate("s", empty, join).alias("runs"))
    return marked.select("doc_id", "digest").join(runs, "digest").select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS body
  FROM b WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS body
  FROM d, lengths WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, p.pos, p.n, x.item_id FROM places p JOIN windows x ON x.body = p.body AND x.n = p.n
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM (SELECT DISTINCT doc_id, pos, n FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

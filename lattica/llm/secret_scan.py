"""Secret scans through a trigram inverted index.

Every rule is a regular expression. From its parsed form a Boolean query over
trigrams is derived (a conjunction of disjunctions): every match of the rule
must contain the trigrams of at least one branch of each clause. Each segment
(a bounded run of rows of one input partition) gets an inverted index of the
trigrams that occur in any rule's query; postings are intersected or united as
the query says, and only candidate texts are verified with the expression. A
rule that has no mandatory trigram scans the whole segment.

Segments are local to a partition, so the scan needs no shuffle, its memory is
bounded by the segment, and a lost task is simply run again.

Defined results: a null text is an empty text and has no spans; repeated rows
each get their own result; further columns are ignored by ``scan`` and kept by
``redact``; an empty table gives an empty result. Spans count code points.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre_c
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import give_back, rows_of, small_batches

#: The three base kinds, in their listed order.
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` is matched leftmost without overlap; a
    match counts if group ``group`` (0: all of it) has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")

#: From the banner to the END banner; without one before the next key, over the
#: header and base64 lines that follow.
_BREAK = r"(?:[\x20\t]*(?:\r?\n|\\r\\n|\\n))"
_PRIVATE_KEY = (
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|(?:{_BREAK}[A-Za-z-]+:\x20[^\r\n]*)*(?:{_BREAK}+[\x20\t]*[A-Za-z0-9+/]+={{0,2}}(?=[\x20\t]*(?:[\r\n\\]|\Z)))*)"
)

#: The base rules come first; the others are well-known public formats.
RULES: tuple[Rule, ...] = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that have 24 characters
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("private_key", _PRIVATE_KEY),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
)


# --- from a regular expression to a Boolean trigram query -------------------

#: A query is a list of clauses, all of which hold; a clause is a set of
#: branches (frozensets of trigrams), one of which holds. [] matches anything.
Query = list[frozenset[frozenset[str]]]
_MOST_LITERALS = 64


def _literals(parsed) -> list[list[set[str] | None]]:
    """The alternatives of an expression, each a sequence of sets of
    characters; None marks a gap where anything may stand."""
    alternatives: list[list[set[str] | None]] = [[]]

    def extend(tails):
        nonlocal alternatives
        if len(alternatives) * len(tails) > _MOST_LITERALS:
            tails = [[None]]
        alternatives = [[*a, *t] for a in alternatives for t in tails]

    for op, arg in parsed:
        if op is sre_c.LITERAL:
            extend([[{chr(arg).lower()}]])
        elif op is sre_c.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is sre_c.LITERAL:
                    chars.add(chr(value).lower())
                else:
                    chars = None
                    break
            extend([[chars if chars and len(chars) <= 2 else None]])
        elif op is sre_c.SUBPATTERN:
            extend(_literals(arg[3]))
        elif op is sre_c.BRANCH:
            extend([t for branch in arg[1] for t in _literals(branch)])
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT):
            low, high, inner = arg
            once = _literals(inner)
            if (low, high) == (0, 1):
                extend([[], *once])
            elif low == high and low * max(len(x) for x in once) <= 8 and len(once) == 1:
                extend([once[0] * low])
            elif low:
                extend([[*t, None] for t in once])
            else:
                extend([[None]])
        elif op is sre_c.AT:
            continue
        else:
            extend([[None]])
    return alternatives


def _trigrams(sequence: list[set[str] | None]) -> frozenset[str] | None:
    """The mandatory trigrams of one alternative; None if it has none."""
    found = set()
    for i in range(len(sequence) - 2):
        window = sequence[i : i + 3]
        if all(c is not None and len(c) == 1 for c in window):
            gram = "".join(next(iter(c)) for c in window)
            if gram.isascii():
                found.add(gram)
    return frozenset(found) or None


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-cased trigrams that every match obeys;
    [] if some alternative has no mandatory trigram."""
    branches = [_trigrams(s) for s in _literals(sre_parse.parse(pattern))]
    if any(b is None for b in branches):
        return []
    return [frozenset(branches)]


def _code(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 16 | b << 8 | c


# --- the index of a segment ----------------------------------------------

#: Fixed rule: A-Z fold to a-z, other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Bytes of texts whose trigrams are coded at a time, which takes some twenty
#: times as many; and of a segment.
PIECE, SEGMENT = 1 << 18, 1 << 20


class Segment:
    """Inverted index over one bounded run of UTF-8 texts."""

    def __init__(self, texts: pa.Array, known: np.ndarray):
        self.rows = len(texts)
        self.known = known  # sorted trigram codes
        data = texts.cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], dtype=np.int64, count=self.rows + 1 + data.offset)[data.offset :]
        raw = data.buffers()[2]
        if raw is None or not len(known) or ends[-1] - ends[0] < 3:
            self.grams = np.empty(0, np.int64)
            self.row = np.empty(0, np.int64)
        else:
            data, ends, found = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0], []
            for lo in range(0, len(data) - 2, PIECE):
                held = _FOLD[data[lo : lo + PIECE + 2]].astype(np.uint32)
                codes = held[:-2] << 16 | held[1:-1] << 8 | held[2:]
                place = np.searchsorted(known, codes)
                place[place == len(known)] = 0
                hits = np.flatnonzero(known[place] == codes)
                row = np.searchsorted(ends, hits + lo, side="right")
                inside = hits + lo + 3 <= ends[row]
                found.append(np.unique(place[hits[inside]].astype(np.int64) * self.rows + row[inside]))
            pairs = np.unique(np.concatenate(found))
            self.grams, self.row = pairs // self.rows, pairs % self.rows

    def postings(self, gram: int) -> np.ndarray:
        at = int(np.searchsorted(self.known, gram))
        lo, hi = np.searchsorted(self.grams, [at, at + 1])
        return self.row[lo:hi]

    def candidates(self, query: Query) -> np.ndarray:
        """Row numbers that satisfy the query, ascending; all rows for []."""
        if not query:
            return np.arange(self.rows)
        found = None
        for clause in query:
            union = np.empty(0, np.int64)
            for branch in clause:
                lists = sorted((self.postings(_code(g)) for g in branch), key=len)
                both = lists[0]
                for other in lists[1:]:
                    both = np.intersect1d(both, other, assume_unique=True)
                union = np.union1d(union, both)
            found = union if found is None else np.intersect1d(found, union, assume_unique=True)
        return found


def _vocabulary(rules: tuple[Rule, ...]) -> np.ndarray:
    grams = {g for r in rules for clause in trigram_query(r.pattern) for branch in clause for g in branch}
    return np.array(sorted(map(_code, grams)), dtype=np.uint32)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The postings of the rules' trigrams as a table (trigram, keys), one row
    for each trigram and segment, for searches over a stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(rules)
        for batch in rows_of(batches, SEGMENT):
            texts = batch.column(1).fill_null("")
            index = Segment(texts, known)
            grams, keys = [], []
            for code in known.tolist():
                rows = index.postings(code)
                if len(rows):
                    grams.append(bytes([code >> 16, code >> 8 & 255, code & 255]).decode())
                    keys.append(batch.column(0).take(pa.array(rows)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["trigram", "keys"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "trigram string, keys array<bigint>")


class Scanner:
    """Finds the spans of a segment's texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        self.known = _vocabulary(rules)

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, str]]]:
        found: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
        index = Segment(texts, self.known)
        held: dict[int, str] = {}
        for rule, compiled, query in self.rules:
            for row in index.candidates(query).tolist():
                if (text := held.get(row)) is None:
                    text = held[row] = texts[row].as_py()
                for m in _matches(rule, compiled, text):
                    found[row].append((m.start(), m.end(), rule.kind))
        for spans in found:
            if len(spans) > 1:
                spans.sort(key=lambda s: (s[0], self.order[s[2]], s[1]))
        return found


def _matches(rule: Rule, compiled: re.Pattern, text: str):
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row (doc_id, spans array<struct<kind,start,end>>) for each row."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in rows_of(batches, SEGMENT):
            found = scanner.spans(batch.column(1).fill_null(""))
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s rows."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every span of a secret replaced by ``mask``; touching or
    overlapping spans become one mask. Null texts stay null, clean texts and
    all other columns stay as they are; ``length`` follows the new text."""
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in rows_of(batches, SEGMENT):
            texts = batch.column(at)
            found = scanner.spans(texts.fill_null(""))
            if any(found):
                new = texts.to_pylist()
                for row, spans in enumerate(found):
                    if spans:
                        new[row] = _masked(new[row], spans, mask)
                columns = list(batch.columns)
                columns[at] = pa.array(new, texts.type)
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch
        give_back()

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, schema)
    if length in docs.columns:
        out = out.withColumn(length, F.coalesce(F.length(text), F.col(length)).cast(schema[length].dataType))
    return out


def _masked(text: str, spans, mask: str) -> str:
    out, last = [], 0
    for start, end, _ in sorted(spans):
        if start > last or not out:
            out += [text[last:start], mask]
        last = max(last, end)
    return "".join(out) + text[last:]

"""Token ids as flat unsigned integer files with 64-bit document offsets.

A shard is three little-endian files: ``<name>.bin`` (all ids, uint16 where
the vocabulary fits, else uint32), ``<name>.off`` (uint64 offsets of its
documents into the ids, one more than documents) and ``<name>.doc`` (int64
doc_ids, then one byte per document that is 1 for a null doc_id). Shards hold
ascending ranges of doc_id, of about ``shard_bytes`` of text; rows of one
doc_id are in the order of a hash of their text and may go on in the next shard.
A shard's base in the whole corpus is the prefix sum of the token counts before
it.

Defined results: a null text is an empty text (its only id is the end id);
null doc_ids come first; repeated rows are all written; other columns are
ignored; an empty table writes no shard. Every attempt of a task writes names of
its own; the manifest names the files of the attempts that counted, and what
others left is deleted.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import give_back, rows_of, shuffle_partitions

#: White space as Unicode's White_Space property has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


#: Fixed rule of byte-level vocabularies: printable bytes of Latin-1 stand for
#: themselves, the others, in order, for the characters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_CHARS = {b: chr(b) if b in _PRINTABLE else chr(0x100 + _OTHERS.index(b)) for b in range(256)}
_BLANK = _BYTE_CHARS[0x20]
_MARKS = ".,;:!?"
LONG = 64
OVERHEAD = 160  # of an entry that is remembered, in bytes


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    The library's pre-tokenizer never joins characters across the units of
    ``_UNIT`` (white space, or one optional blank and the characters up to the
    next white space), so each unit is encoded once by the library and
    remembered, up to ``most`` units and ``most_bytes``; later ones, and units
    of more than ``LONG`` characters, are forgotten after their batch. A unit of letters, with at most one mark after them, is one word (and
    a mark) to the pre-tokenizer and goes to the library's BPE model directly;
    every other unit goes through the whole library. A file whose pre-tokenizer
    or normaliser is another one is encoded text by text.
    """

    def __init__(self, file: str, most: int = 1_000_000, most_bytes: int = 224 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.dtype = np.dtype("<u4" if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16 else "<u2")
        self.known: dict[str, bytes] = {}
        self.most, self.most_bytes, self.bytes = most, most_bytes, 0
        self.bpe = self.library.model.tokenize
        described = str(self.library.pre_tokenizer)
        self.by_unit = self.library.normalizer is None and described.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in described
        self.marks = {m: self._ids(m) for m in _MARKS}
        self.by_unit &= not any(t.content.strip(" ").isalpha() for t in self.library.get_added_tokens_decoder().values())
        self.code = "I" if self.dtype.itemsize == 4 else "H"

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _unit(self, unit: str) -> bytes:
        word, mark = unit, b""
        if unit[-1] in self.marks:
            word, mark = unit[:-1], self.marks[unit[-1]]
        if word.lstrip(" ").isalpha():
            plain = word.replace(" ", _BLANK) if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array(self.code, [t.id for t in self.bpe(plain)]).tobytes() + mark
        return self._ids(unit)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text and the end id, as little-endian bytes."""
        tail = np.array([end], dtype=self.dtype).tobytes()
        if not self.by_unit:
            return [(self._ids(t) if t else b"") + tail for t in texts]
        known = self.known
        split = [_UNIT.findall(t) if t else [] for t in texts]
        new = set().union(*split).difference(known)
        for u in new:
            known[u] = self._unit(u)
        out = [b"".join([*map(known.__getitem__, units), tail]) for units in split]
        for u in [u for u in new if len(u) > LONG]:
            new.remove(u)
            del known[u]
        cost = sum(map(len, new)) + sum(map(len, map(known.__getitem__, new))) + OVERHEAD * len(new)
        if len(known) > self.most or self.bytes + cost > self.most_bytes:
            for u in new:
                del known[u]
            return out
        self.bytes += cost
        return out


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    """One for each Python worker, so what it remembers outlives a task."""
    return Encoder(file)


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")


def _uri(root: str) -> str:
    return "file://" + root[5:] if re.match("file:/[^/]", root) else root


def write(docs: DataFrame, root: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text", shards: int | None = None, shard_bytes: int = 1 << 30) -> DataFrame:
    """Encode every text and write the shards below ``root``, a folder that all
    executors see. Returns the manifest (shard, name, docs, tokens, base,
    width), one row a shard, in order; it is also written to ``root/manifest``.

    Texts are shuffled once, by ranges of ``key`` and the hash (compressed they
    are smaller than their ids, and the sampling of the ranges then encodes
    nothing), and each task encodes and writes its range as it reads it. The
    driver sees one row for each shard.
    """
    spark = docs.sparkSession
    root = _uri(root)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width = encoder.dtype.itemsize
        part, made = TaskContext.get().partitionId(), None
        lengths: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        where, base = _open(root)
        name = f"{part:07d}-{uuid.uuid4().hex[:12]}"
        for batch in rows_of(batches, 4 << 20):
            ids = encoder.encode(batch.column(1).to_pylist(), end)
            if made is None:
                where.create_dir(base, recursive=True)
                made = where.open_output_stream(f"{base}/{name}.bin")
            made.write(b"".join(ids))
            lengths.append(np.array([len(x) // width for x in ids], dtype=np.int64))
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        if made is None:
            return
        made.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
        with where.open_output_stream(f"{base}/{name}.off") as out:
            out.write(offsets.tobytes())
        with where.open_output_stream(f"{base}/{name}.doc") as out:
            out.write(np.concatenate(keys).tobytes() + np.concatenate(nulls).tobytes())
        numbers = [pa.array([x], pa.int64()) for x in (part, len(offsets) - 1, int(offsets[-1]), width)]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array([name])], ["shard", "docs", "tokens", "width", "name"])
        give_back()

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    if shards is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(shuffle_partitions(spark), -(-size // shard_bytes))
    placed = texts.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    written = placed.mapInArrow(store, "shard long, docs long, tokens long, width long, name string").collect()
    rows, base = [], 0
    for r in sorted(written, key=lambda r: r.shard):
        rows.append((r.shard, r.name, r.docs, r.tokens, base, r.width))
        base += r.tokens
    manifest = spark.createDataFrame(rows, "shard long, name string, docs long, tokens long, base long, width long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
    _sweep(root, {r.name for r in written})
    return spark.read.parquet(f"{root}/manifest")


def _sweep(root: str, names: set[str]) -> None:
    """Deletes the files of attempts that did not count."""
    where, base = _open(root)
    for found in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        name, _, suffix = found.base_name.rpartition(".")
        if suffix in ("bin", "off", "doc") and name not in names:
            where.delete_file(found.path)


class _File:
    """Ranges of a file of numbers: a memory map if it lies in a mounted file
    system, else reads of the ranges asked for."""

    def __init__(self, where: fs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        size = where.get_file_info(path).size
        self.map = self.file = None
        if not isinstance(where, fs.LocalFileSystem):
            self.file = where.open_input_file(path)
        elif size:
            self.map = np.memmap(path, dtype=self.dtype, mode="r")
        self.n = size // self.dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: slice) -> np.ndarray:
        lo, hi, _ = at.indices(self.n)
        if self.map is not None:
            return self.map[lo:hi]
        if self.file is None or hi <= lo:
            return np.empty(0, self.dtype)
        wide = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((hi - lo) * wide, lo * wide), self.dtype)


class Shard:
    """One shard, of which only the ranges asked for are read."""

    def __init__(self, root: str, name: str, width: int):
        where, base = _open(_uri(root))
        self.ids = _File(where, f"{base}/{name}.bin", f"<u{width}")
        self.offsets = _File(where, f"{base}/{name}.off", "<u8")
        self.tail = _File(where, f"{base}/{name}.doc", "u1")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc_ids(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of documents lo to hi, and which of them are null."""
        n = len(self)
        return np.frombuffer(self.tail[8 * lo : 8 * hi].tobytes(), "<i8"), np.asarray(self.tail[8 * n + lo : 8 * n + hi], bool)

    def tokens(self, i: int) -> np.ndarray:
        lo, hi = self.offsets[i : i + 2]
        return self.ids[int(lo) : int(hi)]


def documents(spark: SparkSession, root: str, manifest: DataFrame | None = None, step: int = 512, task_tokens: int = 1 << 24) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32) for each
    document. Shards are read in slices of about ``task_tokens`` ids."""
    root = _uri(root)
    if manifest is None:
        manifest = spark.read.parquet(f"{root}/manifest")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(root, row["name"], row["width"])
                first, end = (len(shard) * k // row["slices"] for k in (row["slice"], row["slice"] + 1))
                for at in range(first, end, step):
                    stop = min(at + step, end)
                    bounds = np.asarray(shard.offsets[at : stop + 1]).astype(np.int64)
                    crc = [zlib.crc32(np.asarray(shard.ids[lo:hi]).astype("<u4")) for lo, hi in zip(bounds.tolist(), bounds[1:].tolist())]
                    ids, null = shard.doc_ids(at, stop)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64(), mask=null), pa.array(bounds[:-1] + row["base"], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
        give_back()

    slices = F.greatest(F.lit(1), F.least(F.col("docs"), F.ceil(F.col("tokens") / F.lit(float(task_tokens)))))
    cut = manifest.withColumn("slices", slices.cast("int")).select("name", "base", "width", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    spread = cut.repartition(max(1, shuffle_partitions(spark)), "name", "slice")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")

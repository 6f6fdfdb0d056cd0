"""Token counts with prefix tables, and token-id shards with a minimal perfect hash index.

A shard file holds, little-endian: a header, the documents' keys and offsets in ascending key order, the index, and the raw ids
of all documents one after the other (two bytes an id if the vocabulary allows, four otherwise). The index is a minimal perfect hash: a
cascade of bit arrays in which every key has a bit of its own, the rank of that bit being the key's slot; the slot
holds a fingerprint of the key and the document's number. A lookup reads the header, a bit or two, a fingerprint, two offsets and the document;
header and documents have sums of their own, so that it needs nothing else of the file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.llm.bpe import Counter, Encoder, once, text_groups
from kinmesh.llm.bytesvec import mix, text_bytes
from kinmesh.llm.common import deleted_at_exit, running, scratch, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
END_ID = 2
#: Ids of a shard, but for a longer document, which is a shard of its own.
SHARD_IDS = 4 << 20
#: Shards up to this number have their starts broadcast (about 60 bytes each); beyond it they are joined by shuffle.
BROADCAST_SHARDS = 100_000
MAGIC = b"KMTOKEN3"
_HEADER = struct.Struct("<8sIIQQQ")
#: After the header: length and CRC of all that follows, and the CRC of the header and these two.
_SEAL = struct.Struct("<QI")
_HEAD_SUM = struct.Struct("<I")
_SEED = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint64(0xC2B2AE3D27D4EB4F)


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare name as the public tokenizers' package knows it on the machine that asks."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit, fits_chars.

    n_tokens is the whole text's count; fits_chars is the largest number of leading characters that take at most limit
    tokens, inside a piece too. Null counts as empty: no bytes, no tokens. Repeated rows are counted each; other columns of docs play no part.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fits_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once("counter", vocabulary_path(vocabulary), Counter)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            parts = [counter.totals_of(data, offsets, low, high, limit) for low, high in text_groups(offsets)]
            n, fits = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit), pa.array(fits)], schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def with_prefix_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """docs plus prefix_tokens: the exact count of text[:0], text[:1], ... Budget questions are lookups in it.

    Null counts as empty: [0]. A list is as long as its text, whatever its length, and is worked out in one pass over it. Repeated rows are
    counted each; a column named prefix_tokens is replaced; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() != "prefix_tokens"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("prefix_tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once("counter", vocabulary_path(vocabulary), Counter)
        for batch in batches:
            counts = [counter.prefix_counts(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.list_(pa.int64()))], schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of (bits, number of bits set before each 64-bit word)."""

    GAMMA = 1.5

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], bases: list[int]) -> None:
        self.levels, self.bases = levels, bases

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys + np.uint64((level + 1) * int(_SEED) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, bases, left, done = [], [], keys, 0
        while len(left):
            size = (int(cls.GAMMA * len(left)) // 64 + 1) * 64
            at = cls.place(left, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view("<u8")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]).astype("<u4")
            levels.append((words, ranks))
            bases.append(done)
            done += int(alone.sum())
            left = left[~alone]
        return cls(levels, bases)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a key that was not there at the build, any slot or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(self.levels):
            at = self.place(keys[open_], level, len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[here]] = (self.bases[level] + ranks[word].astype(np.int64) + below)[here]
            open_ = open_[~here]
            if not len(open_):
                break
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _MARK) >> np.uint64(32)).astype("<u4")


def pack_shard(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """A shard file. keys ascend, nulls first; documents with the same key stand together."""
    null = np.array([k is None for k in keys], bool)
    key = np.array([0 if k is None else k for k in keys], "<i8")
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    valued = np.flatnonzero(~null)
    first = valued[np.concatenate([[True], np.diff(key[valued]) != 0])] if len(valued) else valued
    distinct = key[first].view("<u8")
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    prints, number = np.zeros(len(first), "<u4"), np.zeros(len(first), "<u4")
    prints[slot], number[slot] = _fingerprints(distinct), first
    header = _HEADER.pack(MAGIC, width, len(index.levels), len(keys), len(first), int(offsets[-1]))
    raw = [i.astype(f"<u{width}").tobytes() for i in ids]
    sums = np.array([zlib.crc32(r) for r in raw], "<u4")
    parts = [key.tobytes(), null.astype(np.uint8).tobytes(), offsets.tobytes(), sums.tobytes(), prints.tobytes(), number.tobytes()]
    for (words, ranks), base in zip(index.levels, index.bases, strict=True):
        parts += [struct.pack("<QQ", len(words), base), words.tobytes(), ranks.tobytes()]
    body = b"".join(parts + raw)
    head = header + _SEAL.pack(len(body), zlib.crc32(body))
    return head + _HEAD_SUM.pack(zlib.crc32(head)) + body


class Far:
    """An array in a file of which only the places asked for are read."""

    def __init__(self, read: Callable[[int, int], bytes], at: int, kind: str, n: int) -> None:
        self.read, self.at, self.kind, self.n = read, at, np.dtype(kind), n
        self.nbytes = n * self.kind.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, place):
        if isinstance(place, slice):
            return np.frombuffer(self.read(self.at + place.start * self.kind.itemsize, (place.stop - place.start) * self.kind.itemsize), self.kind)
        if isinstance(place, np.ndarray):
            return np.array([self[int(i)] for i in place], self.kind)
        return self[place : place + 1][0]


class Shard:
    """A shard file: all of it, read without copying and checked as a whole, or one that is read where it is asked."""

    def __init__(self, blob: bytes | Callable[[int, int], bytes]) -> None:
        far = callable(blob)
        start = _HEADER.size + _SEAL.size
        head = blob(0, start + _HEAD_SUM.size) if far else bytes(memoryview(blob)[: start + _HEAD_SUM.size])
        if len(head) < start + _HEAD_SUM.size or head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        if zlib.crc32(head[:start]) != _HEAD_SUM.unpack_from(head, start)[0]:
            raise ValueError("a shard file that is torn or was changed")
        _, self.width, n_levels, n_docs, n_keys, n_ids = _HEADER.unpack_from(head)
        length, crc = _SEAL.unpack_from(head, _HEADER.size)
        at = start + _HEAD_SUM.size
        if not far and (len(blob) < at + length or zlib.crc32(memoryview(blob)[at : at + length]) != crc):
            raise ValueError("a shard file that is torn or was changed")

        def take(kind: str, n: int) -> np.ndarray | Far:
            nonlocal at
            out = Far(blob, at, kind, n) if far else np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.null, self.offsets = take("<i8", n_docs), take("?", n_docs), take("<u8", n_docs + 1)
        self.sums, self.prints, self.number = take("<u4", n_docs), take("<u4", n_keys), take("<u4", n_keys)
        levels, bases = [], []
        for _ in range(n_levels):
            n, base = struct.unpack("<QQ", take("u1", 16)[0:16].tobytes())
            levels.append((take("<u8", n), take("<u4", n)))
            bases.append(base)
        self.index = PerfectHash(levels, bases)
        self.ids = take(f"<u{self.width}", n_ids)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key, -1 for keys that are not here (but for a chance of 2**-32)."""
        as_codes = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.index.slots(as_codes)
        here = slot >= 0
        here[here] = self.prints[slot[here]] == _fingerprints(as_codes[here])
        out = np.full(len(slot), -1, np.int64)
        out[here] = self.number[slot[here]]
        return out

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first document with a key, checked by its own sum."""
        at = int(self.find(np.array([key]))[0])
        if at < 0 or int(self.keys[at]) != key:
            return None
        ids = self.document(at)
        if zlib.crc32(ids.tobytes()) != int(self.sums[at]):
            raise ValueError("a shard file that is torn or was changed")
        return ids

    def document(self, number: int) -> np.ndarray:
        return self.ids[int(self.offsets[number]) : int(self.offsets[number + 1])]


def write_shards(docs: DataFrame, path: str, *, vocabulary: str = VOCABULARY, end_id: int | None = END_ID, id_col: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes shard files below path, one for each folder shard=.../n_ids=.../first_key=.../last_key=... ; shards in order hold the documents in ascending id order.

    Documents are dealt out by ranges of the id; equal ids stay together, ordered by text; null ids come first and are
    not in the index. Null texts are empty; a document of more than shard_ids is a shard of its own; repeated rows are written each;
    other columns play no part; an empty table makes no file. A file is the shard and one line feed, which belongs to no section.
    """
    schema = T.StructType([T.StructField("shard", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("n_ids", "first_key", "last_key")), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once("encoder", vocabulary_path(vocabulary), Encoder)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal keys, held, size, seq
            first = next((k for k in keys if k is not None), None)
            row = [f"s{part:08d}-{seq:06d}", sum(map(len, held)), first, keys[-1], pack_shard(keys, held, width)]
            keys, held, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), *[pa.int64()] * 3, pa.binary()), strict=True)], schema.names)

        for batch in batches:
            names, (data, offsets) = batch.column(id_col).to_pylist(), text_bytes(batch.column(text))
            for low, high in text_groups(offsets):
                for key, ids in zip(names[low:high], encoder.encode_of(data, offsets, low, high), strict=True):
                    if keys and key != keys[-1] and size + len(ids) > shard_ids:
                        yield packed()
                    keys.append(key)
                    held.append(np.concatenate([ids, tail]).astype(f"<u{width}"))
                    size += len(held[-1])
        if keys:
            yield packed()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), F.col(f"`{text}`").alias(text))
    ordered = rows.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text)
    names = ("shard", "n_ids", "first_key", "last_key")
    shards = ordered.mapInArrow(run, schema).select(*names, F.col("blob").cast("string").alias("blob"))
    shards.write.partitionBy(*names).text(path)


def get(spark: SparkSession, path: str, key: int) -> np.ndarray | None:
    """Ids of the first document with a key, or None. The folders' key ranges leave one file, and of that a number of ranges that depends on the
    levels of its index alone is read, besides the document. A changed header or document is refused; read_shards checks whole files."""
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:
        return None
    for row in files.filter((F.col("first_key").cast("bigint") <= key) & (F.col("last_key").cast("bigint") >= key)).select("path").toLocalIterator():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row["path"])
        stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)

        def read(at: int, n: int, stream=stream) -> bytes:
            stream.seek(at)
            return bytes(stream.readNBytes(n))

        try:
            found = Shard(read).get(key)
        finally:
            stream.close()
        if found is not None:
            return found
    return None


def read_shards(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each document of the shard files: id, start (ids of all documents before it), n_tokens, ids_crc32, found through each file's index."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # of an empty table there are no shards
        return spark.createDataFrame([], schema)
    files = files.withColumn("n_ids", F.col("n_ids").cast("bigint"))
    starts = running(files.select("shard", "n_ids"), [], [F.col("shard").asc()], F.col("n_ids"), "base", "starts").select("shard", "base")
    few = files.select("shard").limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    rows = files.select("shard", "content").join(F.broadcast(starts) if few else starts, "shard").select("base", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(blob.as_buffer())
                n = len(shard.keys)
                number = np.arange(n)
                valued = np.flatnonzero(~shard.null)
                first = shard.find(shard.keys[valued])
                # Documents that share a key follow its first one.
                again = valued - np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(shard.keys[valued]) != 0])[: len(valued)], valued, 0))
                number[valued] = first + again
                sizes = np.diff(shard.offsets.astype(np.int64))[number]
                sums = [zlib.crc32(shard.document(int(i)).astype("<u4").tobytes()) for i in number]
                keys = pa.array(shard.keys, pa.int64(), mask=shard.null)
                yield pa.RecordBatch.from_arrays([keys, pa.array(base + shard.offsets[:-1].astype(np.int64)[number]), pa.array(sizes), pa.array(sums, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    deleted_at_exit(spark, path)
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)

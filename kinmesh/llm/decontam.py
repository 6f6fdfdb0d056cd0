"""Benchmark decontamination by a broadcast set of benchmark n-grams.

The windows of the benchmark (N consecutive words; an item with fewer is one window) are hashed into a sorted set
behind a bitmap. Workers roll the same hash over every document, look at those places only that the set holds, and compare the
words there with the item's. Covered words and items decide whether a document is contaminated.

The broadcast is bounded: a benchmark above BLOCK_BYTES of text is taken in blocks, a job of its own for each, so that no process
holds more than one block. What a block finds in a text is written under two hashes of the text, and joined to the rows at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.llm.bytesvec import ALNUM, Words, groups, text_bytes
from kinmesh.llm.common import stored, table

N = 13
#: A document is contaminated if it has a hit and hits are at least one in so many words.
DILUTION = 20
#: Text bytes of a block; its index takes about five times as much.
BLOCK_BYTES = 8 << 20
_BITS = 20
_FOUND = T.StructType([*(T.StructField(n, T.LongType()) for n in ("_km_k1", "_km_k2")), T.StructField("_km_cov", T.ArrayType(T.LongType())), T.StructField("_km_items", T.ArrayType(T.StringType()))])


class Index:
    """Windows of a block of items: for each length, sorted codes with the item and place of each."""

    def __init__(self, items: list[tuple[str | None, str]], n: int = N) -> None:
        self.names = [name for name, _ in items]
        texts = pa.array([text for _, text in items], pa.string())
        data, offsets = text_bytes(texts)
        self.joined: list[bytes] = []
        self.at: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k in range(len(items)):
            w = Words(data, offsets, k, k + 1, ALNUM)
            count = len(w.codes)
            self.joined.append(w.joined(0, count))
            self.at.append(np.concatenate([[0], np.cumsum(w.ends - w.starts + 1)]))
            if count:
                size = min(n, count)
                codes = w.grams(size)
                found.setdefault(size, []).append((codes, np.full(len(codes), k), np.arange(len(codes))))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in found.items():
            codes, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(codes, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[codes >> np.uint64(64 - _BITS)] = True
            self.sizes[size] = (codes[order], item[order].astype(np.int32), place[order].astype(np.int32), bitmap)

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(word, window size, items) of every verified window in w."""
        for size, (codes, item, place, bitmap) in self.sizes.items():
            rolled = w.grams(size)
            maybe = np.flatnonzero(bitmap[rolled >> np.uint64(64 - _BITS)] & w.within(size))
            if not len(maybe):
                continue
            low, high = (np.searchsorted(codes, rolled[maybe], side) for side in ("left", "right"))
            for i, a, b in zip(*(x[high > low].tolist() for x in (maybe, low, high)), strict=True):
                text, items = w.joined(i, size), []
                for j in range(a, b):
                    k, p = item[j], place[j]
                    if self.joined[k][self.at[k][p] : self.at[k][p + size] - 1] == text:
                        items.append(int(k))
                if items:
                    yield i, size, items


def scan_batch(index: Index, texts: pa.Array, covered: list[list[int]] | None = None, named: list[list[str]] | None = None) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Words, covered words (sorted places) and items of each text; covered and named: what earlier blocks have found."""
    data, offsets = text_bytes(texts)
    n_words, places, items = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
    for low, high in groups(offsets):
        w = Words(data, offsets, low, high, ALNUM)
        n_words[low:high] = np.diff(w.first)
        got: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for i, size, found in index.hits(w):
            spans, seen = got.setdefault(int(w.doc[i]), ([], set()))
            spans.append((i, size))
            seen.update(found)
        for d, (spans, seen) in got.items():
            start = int(w.first[d])
            hit = np.zeros(int(w.first[d + 1]) - start + 1, np.int32)
            for i, size in spans:
                hit[i - start] += 1
                hit[i - start + size] -= 1
            places[low + d] = np.flatnonzero(np.cumsum(hit[:-1]) > 0).tolist()
            items[low + d] = sorted({index.names[k] for k in seen} - {None})
    if covered is not None:
        places = [sorted({*a, *(b or ())}) if b else a for a, b in zip(places, covered, strict=True)]
        items = [sorted({*a, *(b or ())}) if b else a for a, b in zip(items, named, strict=True)]
    return n_words, places, items


def indexes(benchmark: DataFrame, *, n: int = N, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """An index for each block of the benchmark. Words of items without an id are hit, but no item is named; items without words play no part."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield Index([(r["name"], r["text"]) for r in part.toLocalIterator()], n)


def _hashes(text: str) -> list:
    return [F.xxhash64(F.col(f"`{text}`")).alias("_km_k1"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("_km_k2")]


def _found(docs: DataFrame, index: Index, text: str) -> DataFrame:
    """What a block finds: one row for each text with a hit, under its hashes."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, places, items = scan_batch(shared.value, batch.column("_km_text"))
            hit = pa.array([k for k, p in enumerate(places) if p], pa.int64())
            lists = (pa.array(v, pa.list_(t)).take(hit) for v, t in ((places, pa.int64()), (items, pa.string())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(hit) for c in ("_km_k1", "_km_k2")), *lists], _FOUND.names)

    rows = docs.select(*_hashes(text), F.col(f"`{text}`").alias("_km_text")).mapInArrow(run, _FOUND)
    out = stored(rows.dropDuplicates(["_km_k1", "_km_k2"]), "hits")
    shared.destroy()
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, how: dict) -> tuple[DataFrame, object]:
    """(rows, broadcast of the index that is left to scan with). Rows: the row itself in one column and, after several blocks, what they found."""
    hidden = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_km_row"), *_hashes(text))
    context, last, found = docs.sparkSession.sparkContext, None, None
    for index in indexes(benchmark, **how):
        if last is not None:
            part = _found(docs, last, text)
            found = part if found is None else found.unionByName(part)
        last = index
    if found is None:
        return hidden.select("_km_row"), context.broadcast(last)
    found = found.unionByName(_found(docs, last, text))
    all_ = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    merged = found.groupBy("_km_k1", "_km_k2").agg(all_("_km_cov"), all_("_km_items"))
    return hidden.join(merged, ["_km_k1", "_km_k2"], "left").select("_km_row", "_km_cov", "_km_items"), context.broadcast(Index([]))


def _scanned(batch: pa.RecordBatch, text: str, shared) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    carried = (batch.column(c).to_pylist() for c in ("_km_cov", "_km_items")) if "_km_cov" in batch.schema.names else (None, None)
    return scan_batch(shared.value, _row(batch).column(text), *carried)


def _row(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_struct_array(batch.column("_km_row"))


def contaminated(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (DILUTION * n_hit >= n_words)


def measure(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; texts of any length are taken whole. Repeated rows are measured each; an empty benchmark
    hits nothing, an empty table stays empty; other columns of docs play no part. Item ids count as strings; repeated items are one; words of items
    without an id are hit, but such items aren't counted.
    """
    rows, shared = _passes(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), benchmark, text, how)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, places, items = _scanned(batch, text, shared)
            n_hit = np.fromiter(map(len, places), np.int64, len(places))
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [_row(batch).column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(contaminated(n_words, n_hit))],
                schema.names,
            )

    return rows.mapInArrow(run, schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """docs without contaminated ones, same columns. Rows without words, and all rows where the benchmark is empty, stay; repeated rows stay or
    go alike; texts of any length are taken whole; no column name clashes; an empty table stays empty."""
    rows, shared = _passes(docs, benchmark, text, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, places, _ = _scanned(batch, text, shared)
            clean = ~contaminated(n_words, np.fromiter(map(len, places), np.int64, len(places)))
            yield _row(batch).filter(pa.array(clean))

    return rows.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """docs with the hit words cut out of their texts (from the first byte of each covered run to its last); other columns as they are.

    Null texts stay null and texts without hits as they are; rows, repeated ones too, are all kept; an empty table stays empty.
    """
    rows, shared = _passes(docs, benchmark, text, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _row(batch)
            column = whole.column(text)
            _, places, _ = _scanned(batch, text, shared)
            data, offsets = text_bytes(column)
            out = column.to_pylist()
            for d, hit in enumerate(places):
                if hit:
                    w, body, kept, at = Words(data, offsets, d, d + 1, ALNUM), data[offsets[d] : offsets[d + 1]].tobytes(), [], 0
                    runs = np.split(np.asarray(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
                    for r in runs:
                        kept.append(body[at : w.starts[r[0]]])
                        at = w.ends[r[-1]]
                    out[d] = b"".join([*kept, body[at:]]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(out, column.type) if c == text else whole.column(c) for c in whole.schema.names], whole.schema.names)

    return rows.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), {N}) AS n, array_to_string(w[i : i + least(len(w), {N}) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {N}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
x AS (SELECT id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT id, n, i, item FROM x JOIN g USING (n, g)),
c AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT id, n, i FROM h)) GROUP BY id),
t AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {DILUTION} * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (id) LEFT JOIN t USING (id)"""

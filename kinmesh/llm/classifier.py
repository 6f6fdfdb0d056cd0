"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A document's terms are its words and the trigrams of its shape (letters, digits and white space as classes, other characters as
they are, runs of a class as one), hashed into fixed buckets, and the number of words that repeat the word before. Terms are weighted by the root of
their number and by inverse document frequency, counted over all documents. A bounded sample of labelled documents gives the latent axes
(singular vectors of its weighted terms) and the labelled vectors. These are broadcast; every document is projected on
the axes and compared with all of them, a block of documents at a time, and its NEIGHBOURS nearest vote, weighted by a power of their cosine.

Nothing of a document but its text goes into its score; what is learnt about labels comes from the rows that aren't held out alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.bytesvec import GROUP_BYTES, SOLID, Words, groups, mix, text_bytes
from kinmesh.llm.common import stored, table

#: Labelled documents that the axes and the votes come from, at most: those first by a hash of the id. Everything else covers all documents.
SAMPLE = 4096
WORD_BUCKETS, SHAPE_BUCKETS, AXES, NEIGHBOURS, POWER = 1024, 1024, 64, 15, 4
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + 1
#: A document counts as good from this score on; one row in FOLDS is held out.
CUTOFF, FOLDS = 0.3, 5
#: Documents of a block.
BLOCK = 256

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x09:0x0E] = ord("A"), ord("0"), ord(" ")
_CLASS = np.zeros(256, bool)
_CLASS[[ord(c) for c in "aA0 "]] = True


def _slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, document of each piece): a text longer than GROUP_BYTES in pieces that end at white space, where one is near."""
    if not len(offsets) or (np.diff(offsets) <= GROUP_BYTES).all():
        return offsets, np.arange(len(offsets) - 1)
    cuts, owner = [int(offsets[0])], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > GROUP_BYTES:
            end = a + GROUP_BYTES
            space = np.flatnonzero(~SOLID[data[end : min(b, end + GROUP_BYTES)]])
            a = end + int(space[0]) if len(space) else min(b, end + GROUP_BYTES)
            cuts.append(a)
            owner.append(k)
        cuts.append(b)
        owner.append(k)
    return np.array(cuts, np.int64), np.array(owner)


def term_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document of each row, counts by term), blocks of at most BLOCK rows; a long text is counted in pieces, a row for each."""
    data, offsets = text_bytes(column)
    cuts, owner = _slices(data, offsets)
    for start, stop in groups(cuts):
        for low in range(start, stop, BLOCK):
            high = min(stop, low + BLOCK)
            words = Words(data, cuts, low, high, SOLID)
            at = cuts[low : high + 1] - cuts[low]
            shape, doc = _SHAPE[data[cuts[low] : cuts[high]]], np.repeat(np.arange(high - low), np.diff(at))
            new = np.ones(len(shape), bool)
            new[1:] = (shape[1:] != shape[:-1]) | (doc[1:] != doc[:-1]) | ~_CLASS[shape[1:]]
            shape, doc = shape[new].astype(np.uint64), doc[new]
            grams = mix(shape[:-2] + (shape[1:-1] << np.uint64(8)) + (shape[2:] << np.uint64(16)))
            whole = doc[:-2] == doc[2:]
            again = np.flatnonzero((words.codes[1:] == words.codes[:-1]) & (words.doc[1:] == words.doc[:-1]))
            places = [
                words.doc * TERMS + (words.codes % np.uint64(WORD_BUCKETS)).astype(np.int64),
                (doc[:-2] * TERMS + WORD_BUCKETS + (grams % np.uint64(SHAPE_BUCKETS)).astype(np.int64))[whole],
                words.doc[again] * TERMS + TERMS - 1,
            ]
            yield owner[low:high], np.bincount(np.concatenate(places), minlength=(high - low) * TERMS).reshape(high - low, TERMS)


def documents_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, counts by term) for blocks of whole documents, in order."""
    held, first = None, 0
    for owner, counts in term_counts(column):
        base = int(owner[0])
        summed = np.add.reduceat(counts, np.searchsorted(owner, np.unique(owner)))
        if held is not None and base == first + len(held) - 1:
            # The last document of the block before goes on.
            summed[0] += held[-1]
            held = held[:-1]
        if held is not None and len(held):
            yield first, held
        held, first = summed, base
    if held is not None and len(held):
        yield first, held


class Model(NamedTuple):
    """idf by term, axes (terms x AXES), vectors of the sample with their ids and labels, and the share of good ones."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    share: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Share of good labels among the nearest; a document of the sample doesn't vote for itself. The share of all where nothing is near."""
        out = np.full(len(counts), self.share)
        if not len(self.labels):
            return out
        cosine = (self.project(counts) @ self.vectors.T).astype(np.float64)
        cosine[ids[:, None] == self.ids[None, :]] = 0
        near = np.argpartition(-cosine, min(NEIGHBOURS, cosine.shape[1]) - 1, axis=1)[:, :NEIGHBOURS]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER
        total = weight.sum(1)
        return np.where(total > 0, np.clip((weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1), 0, 1), out)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32)) * idf.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by FOLDS; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_ids(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label of at most sample labelled documents that aren't held out, of all that docs has; of several labels the worst."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    known = known.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_semi")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _term_rows(ids: list, counts: list[np.ndarray], n: int) -> pa.RecordBatch:
    ends = pa.array(np.arange(0, (len(counts) + 1) * TERMS, TERMS, dtype=np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *counts])))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array([n] * len(ids), pa.int64())], ["doc_id", "counts", "n"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts terms of all documents in one pass, which also brings the sample's terms."""
    chosen = dict(training_ids(docs, labels, sample).collect())
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(frozenset(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for first, counts in documents_of(batch.column("text")):
                frequency += (counts > 0).sum(0)
                n += len(counts)
                rows += [(ids[first + k], counts[k]) for k in range(len(counts)) if ids[first + k] in shared.value]
            yield _term_rows([i for i, _ in rows], [c for _, c in rows], 1)
        yield _term_rows([None], [frequency], n)

    found = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, counts array<bigint>, n long"), "terms")
    shared.destroy()
    total = found.filter("doc_id IS NULL").agg(F.sum("n")).first()[0] or 0
    frequency = np.zeros(TERMS)
    for place, n in found.filter("doc_id IS NULL").select(F.posexplode("counts").alias("place", "n")).groupBy("place").agg(F.sum("n")).collect():
        frequency[place] = n
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    # Of rows with one id the first by its counts: as many rows as ids, sample at most.
    rows = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("counts").alias("counts")).orderBy("doc_id").toArrow()
    ids = rows.column("doc_id").to_numpy()
    if not len(ids):
        return Model(idf, np.zeros((TERMS, AXES), np.float32), np.zeros((0, AXES), np.float32), ids, np.empty(0), 1.0)
    counts = rows.column("counts").combine_chunks()
    x = weighted(np.asarray(counts.flatten()).reshape(len(ids), TERMS), idf)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, -AXES:], np.float32)
    good = np.array([chosen[i] for i in ids.tolist()], np.float64)
    vectors = x @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Model(idf, axes, vectors.astype(np.float32), ids, good, float(good.mean()))


def quality_scores(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better), predicted (1 from CUTOFF on) of each row of docs (doc_id, text; further columns play no part).

    labels: doc_id, quality. Rows of labels with a null id or a quality other than 0 and 1 play no part; of several labels of an id the worst
    counts. Null and empty texts have no terms and get the share of good ones in the sample, as do all where there are no labels (1 then). Texts are taken whole, however
    long. Rows without an id are scored and held out; rows with one id are scored each by its text. An empty table gives an empty table.
    """
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known, out = ids.fill_null(np.iinfo(np.int64).min).to_numpy(), np.zeros(len(ids))
            for first, counts in documents_of(batch.column("text")):
                out[first : first + len(counts)] = shared.value.scores(counts, known[first : first + len(counts)])
            yield pa.RecordBatch.from_arrays([ids, batch.column("held_out"), pa.array(out)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

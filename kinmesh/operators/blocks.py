"""Joins of all records of a group, block by block.

Where most pairs of a group have something in common, an equi-join shuffles all of them. Here both sides are dealt into blocks, each
block meets each of the other side's once, and only what a pair of blocks yields leaves its task. A side is shuffled as
often as the other has blocks; pairs are never shuffled.

How large a block is follows from the counts: there are TASKS pairs of blocks a core, if the groups have that much work, and no block is beyond LEFT_ROWS
or RIGHT_ROWS. A task so holds two blocks, CELLS sums (8 MB) and, where it has Postings, ROWS rows of a matrix over the second block (25 MB at most);
of the first side only SLICE records' terms are looked up at a time.

What is shuffled grows with the number of blocks: each side once for every block of the other, and a query's best once for every block of the second. Where records are small, callers
ask for larger blocks of the second side, take it in pieces of PIECE records (the matrix is over a piece), and hold each query's Best across pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.sources.writers import stored

#: Records of a block of the first and of the second side, at most.
LEFT_ROWS, RIGHT_ROWS = 32_768, 16_384
#: Pairs of blocks for each core, and the records below which a block isn't split for their sake.
TASKS, LEAST_ROWS = 3, 1_024
#: Sizes of groups (60 bytes each) are broadcast up to this number; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Sums a task holds at a time, and the first side's records whose terms it looks up at a time.
CELLS, SLICE = 1 << 20, 4_096
#: The second side's records that are made postings at a time, of a block that holds more.
PIECE = 16_384

Match = Callable[[pa.Table, pa.Table], pa.Table]


def side(cells: float, cores: int) -> int:
    """Records of a block of either side, so that cells pairs of records make up TASKS pairs of blocks a core. Square blocks shuffle least for their number."""
    return max(LEAST_ROWS, math.ceil(math.sqrt(cells / (TASKS * cores))))


def shape(cells: float, cores: int, left_rows: int, right_rows: int) -> tuple[int, int]:
    """Records of a block of the first and of the second side. Where the first side's bound keeps its blocks small, the second's are larger, so that there are no more pairs of blocks than asked for."""
    even = side(cells, cores)
    left = min(left_rows, even)
    return left, min(right_rows, max(even, math.ceil(cells / (TASKS * cores) / left)))


def meet(left: DataFrame, right: DataFrame, group: str, match: Match, schema: str, *, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """match's rows for every two blocks of a group; a group that is null, or on one side only, has none. Both sides have a column id, by which they are dealt.

    left_rows and right_rows bound a block's records (on average; one id's records stay together); match's rows must not depend on how records are dealt.
    """
    spark = left.sparkSession
    counts = lambda df, name: df.groupBy(group).agg(F.count(F.lit(1)).alias(name))
    sizes = stored(counts(left, "_lc").join(counts(right, "_rc"), group), "sizes")
    groups, cells = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_lc").cast("double") * F.col("_rc")), F.lit(0.0))).first()
    left_rows, right_rows = shape(cells, spark.sparkContext.defaultParallelism, left_rows, right_rows)
    parts = lambda count, rows: F.ceil(F.col(count) / rows).cast("int")
    sizes = sizes.select(group, parts("_lc", left_rows).alias("_ln"), parts("_rc", right_rows).alias("_rn"))
    sizes = F.broadcast(sizes) if groups <= BROADCAST_GROUPS else sizes.hint("merge")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, group).withColumn("_l", block("_ln")).withColumn("_r", every("_rn")).drop("_ln", "_rn")
    b = right.join(sizes, group).withColumn("_r", block("_rn")).withColumn("_l", every("_ln")).drop("_ln", "_rn")
    empty = pa.Table.from_batches([], _arrow(spark, schema))

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        return match(x, y) if x.num_rows and y.num_rows else empty

    return a.groupBy(group, "_l", "_r").cogroup(b.groupBy(group, "_l", "_r")).applyInArrow(both, schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and where each row's begin (and the last one's end)."""
    whole = table[column].combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    sizes = np.diff(whole.offsets.to_numpy())
    return whole.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def pieces(block: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """PIECE records of a block after others, and the places of their ids in order of all of the block's."""
    place = np.empty(block.num_rows, np.int32)
    place[by_id(block)] = np.arange(block.num_rows, dtype=np.int32)
    for first in range(0, block.num_rows, PIECE):
        yield place[first : first + PIECE], block.slice(first, PIECE)


def by_id(block: pa.Table) -> np.ndarray:
    return pc.sort_indices(block["id"]).to_numpy()


class Best:
    """The k best of a block's records for each of n others, by score and then by the smaller place, whatever order they come in. Scores are whole numbers from 1 to 2 ** 24."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.places = k, np.zeros((n, k), np.float32), np.full((n, k), np.iinfo(np.int32).max, np.int32)

    def least(self, low: int, n: int) -> np.ndarray:
        """The k-th scores of n records from low on, 0 where there are fewer: a smaller one is not among the best."""
        return self.scores[low : low + n, -1].astype(np.float64)

    def add(self, low: int, i: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the records low + i."""
        i, last = i + low, self.scores[i + low, -1]
        better = (scores > last) | ((scores == last) & (places < self.places[i, -1]))
        i, places, scores = i[better], places[better], scores[better].astype(np.float32)
        rows = np.unique(i)
        if len(rows):
            i = np.concatenate([np.repeat(rows, self.k), i])
            places, scores = np.concatenate([self.places[rows].ravel(), places]), np.concatenate([self.scores[rows].ravel(), scores])
            order = np.lexsort((places, -scores, i))
            i = i[order]
            kept = order[np.arange(len(i)) - np.searchsorted(i, i) < self.k]
            self.scores[rows], self.places[rows] = scores[kept].reshape(-1, self.k), places[kept].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Records, places and scores."""
        i, n = np.nonzero(self.scores)
        return i, self.places[i, n], self.scores[i, n].astype(np.int64)


class Postings:
    """The second side's block by term: which rows have a term, and with what weight."""

    #: From this product of a term's shares of either side on, the term is cheaper as a row of a matrix than as a list.
    COMMON = 1 / 40
    #: Terms held as rows of a matrix.
    ROWS = 192

    def __init__(self, terms: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> None:
        self.n = len(starts) - 1
        self.terms, number = np.unique(terms, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))[order]
        self.weights = weights[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(self.terms)))])

    def sums(self, terms: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For some of the first side's records after others: the number of the first, and a row of sums over common terms for each."""
        n = len(starts) - 1
        for first in range(0, n, SLICE):
            last = min(n, first + SLICE)
            part = slice(starts[first], starts[last])
            for low, out in self._sums(terms[part], starts[first : last + 1] - starts[first], weights[part]):
                yield first + low, out

    def _sums(self, terms: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n = len(starts) - 1
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        owner, at, weights = np.repeat(np.arange(n), np.diff(starts))[known], at[known], weights[known]
        share = np.bincount(at, minlength=len(self.terms)) / max(n, 1) * (np.diff(self.starts) / max(self.n, 1))
        dense = np.argsort(-share, kind="stable")[: self.ROWS]
        dense = dense[share[dense] >= self.COMMON]
        place = np.full(len(self.terms), -1)
        place[dense] = np.arange(len(dense))
        matrix = np.zeros((len(dense), self.n))
        for i, t in enumerate(dense):
            np.add.at(matrix[i], self.rows[self.starts[t] : self.starts[t + 1]], self.weights[self.starts[t] : self.starts[t + 1]])
        bounds = np.searchsorted(owner, np.arange(n + 1))
        step = max(1, CELLS // max(self.n, 1))
        for low in range(0, n, step):
            high = min(n, low + step)
            part = slice(bounds[low], bounds[high])
            whose, term, weight = owner[part] - low, at[part], weights[part]
            common = place[term] >= 0
            asked = np.zeros((high - low, len(dense)))
            np.add.at(asked, (whose[common], place[term[common]]), weight[common])
            out = asked @ matrix
            whose, term, weight = whose[~common], term[~common], weight[~common]
            sizes = self.starts[term + 1] - self.starts[term]
            spans = [slice(x, x + y) for x, y in zip(self.starts[term].tolist(), sizes.tolist(), strict=True)]
            inner = np.searchsorted(whose, np.arange(high - low + 1))
            for i in range(high - low):
                x, y = int(inner[i]), int(inner[i + 1])
                if x < y:
                    rows = np.concatenate([self.rows[s] for s in spans[x:y]])
                    values = np.concatenate([self.weights[s] for s in spans[x:y]])
                    out[i] += np.bincount(rows, values * np.repeat(weight[x:y], sizes[x:y]), self.n)
            yield low, out

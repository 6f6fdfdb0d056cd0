"""Approximate nearest neighbours by an inverted file with residual product quantisation.

Every pool vector is in the list of its nearest centroid and is kept as a code of one byte for every two dimensions of what the
centroid leaves over. A query probes the lists nearest to it: their codes are decoded block by block and scored as matrix products, the best `depth` of
a query are compared by their vectors, and the best k of these are given. Centroids, code books, the number of lists to probe and the depth come from a
bounded sample of the pool; every pool vector is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.operators import blocks
from kinmesh.sources.writers import stored

#: Pool vectors that centroids and code books are fitted on, and of these the ones that probes and depth are measured with, at most.
SAMPLE, MEASURED = 8192, 512
LISTS, CODES, ROUNDS = 256, 256, 8
#: Share of the sample's neighbours that the probed lists, and the candidates within the depth, have to hold; twice as many candidates as neighbours at least.
REACHED = 0.98
#: Lists of a group are put together in cells of about so many vectors, and a cell is dealt into blocks of that size; queries of a cell likewise.
CELL, ASKED = 32_768, 8_192
#: Query rows that a task scores at a time.
STEP = 256
#: Lists of all groups (40 bytes each) are broadcast up to this number; beyond it they are joined by shuffle.
BROADCAST_LISTS = 200_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of a list column, ended by zeros up to dims or cut there; null vectors and components are zeros, as are vectors that aren't finite."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.nan_to_num(np.asarray(column.flatten().fill_null(0.0), np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner, inside = np.repeat(np.arange(len(sizes)), sizes), place < dims
    out = np.zeros((len(sizes), dims))
    out[owner[inside], place[inside]] = flat[inside]
    return unit(out).astype(np.float32)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Seeded centres; an empty one moves to the point that is worst served."""
    draw = np.random.default_rng(seed)
    centres = x[np.sort(draw.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        distance = (centres * centres).sum(1)[None] - 2 * x @ centres.T
        near = distance.argmin(1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        worst = np.argsort(-distance[np.arange(len(x)), near], kind="stable")
        for i, empty in enumerate(np.flatnonzero(count == 0)):
            centres[empty] = x[worst[i % len(worst)]]
    return centres


@dataclass
class Quantizer:
    dims: int
    centroids: np.ndarray
    #: One book of pairs for each two dimensions.
    books: np.ndarray
    probes: int
    depth: int

    def near(self, x: np.ndarray) -> np.ndarray:
        return ((self.centroids * self.centroids).sum(1)[None] - 2 * x @ self.centroids.T).argmin(1)

    def encode(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[near]
        pairs = np.pad(rest, ((0, 0), (0, rest.shape[1] % 2))).reshape(len(x), -1, 2)
        out = np.empty(pairs.shape[:2], np.uint8)
        for m, book in enumerate(self.books):
            out[:, m] = ((book * book).sum(1)[None] - 2 * pairs[:, m] @ book.T).argmin(1)
        return out

    def decode(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], 1) if len(self.books) else np.zeros((len(codes), 0, 2), np.float32)
        return self.centroids[near] + out.reshape(len(codes), -1)[:, : self.dims]

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Lists of each query, those of the largest products with their centroids."""
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, : self.probes].astype(np.int32)


def fit_arrays(x: np.ndarray, groups: np.ndarray, n: int, k: int, seed: int = 42) -> Quantizer:
    """From sample x (unit vectors) and their groups, for a pool of n. Lists are numbered along their main direction, so that neighbours lie together."""
    dims = x.shape[1]
    centroids = k_means(x, max(1, min(LISTS, round(n**0.5), len(x))), seed)
    main = np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0] if len(centroids) > 1 else np.zeros(dims)
    q = Quantizer(dims, np.ascontiguousarray(centroids[np.argsort(centroids @ main, kind="stable")], np.float32), np.zeros((0, 1, 2), np.float32), 1, k)
    near = q.near(x)
    rest = np.pad(x - q.centroids[near], ((0, 0), (0, dims % 2))).reshape(len(x), -1, 2)
    q.books = np.stack([k_means(rest[:, m], CODES, seed + m) for m in range(rest.shape[1])]).astype(np.float32) if dims else q.books
    # Neighbours within the group, in the sample: thinner than the pool, so they lie farther off and ask for more probes.
    exact, rough = x[:MEASURED] @ x.T, x[:MEASURED] @ q.decode(near, q.encode(x, near)).T
    order = np.empty((min(len(x), MEASURED), len(q.centroids)), np.int64)
    np.put_along_axis(order, np.argsort(-(x[:MEASURED] @ q.centroids.T), axis=1, kind="stable"), np.arange(len(q.centroids))[None], 1)
    ranks, depths = [], []
    for i in range(len(exact)):
        others = np.flatnonzero((groups == groups[i]) & (np.arange(len(x)) != i))
        best = others[np.argsort(-exact[i, others], kind="stable")[:k]]
        ranks += order[i, near[best]].tolist()
        if len(best):
            depths += (rough[i, others][None] > rough[i, best][:, None]).sum(1).tolist()
    q.probes = min(len(q.centroids), int(np.quantile(ranks, REACHED)) + 1) if ranks else len(q.centroids)
    q.depth = max(2 * k, int(np.quantile(depths, REACHED)) + k) if depths else 2 * k
    return q


def fit(pool: DataFrame, *, k: int, group: str = "country_norm", seed: int = 42, sample: int = SAMPLE) -> Quantizer:
    n = pool.count()
    rows = pool.orderBy(F.xxhash64("entity_id", F.lit(seed))).limit(sample).select(F.col(group).cast("string").alias("g"), F.col("embedding").cast("array<double>").alias("e")).toArrow()
    column = rows.column("e").combine_chunks()
    dims = max(np.asarray(column.value_lengths().fill_null(0)).tolist(), default=0)
    names = np.unique(np.array([str(g) for g in rows.column("g").to_pylist()], object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    return fit_arrays(vectors(column, dims), names, n, k, seed) if n else Quantizer(0, np.zeros((1, 0), np.float32), np.zeros((0, 1, 2), np.float32), 1, k)


def index(pool: DataFrame, quantizer: Quantizer, group: str = "country_norm") -> DataFrame:
    """id, group, list, code of every pool vector; stored."""
    shared = pool.sparkSession.sparkContext.broadcast(quantizer)
    rows = pool.select(F.col("entity_id").alias("id"), F.col(group).alias("g"), F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            x = vectors(batch.column("e"), q.dims)
            near = q.near(x)
            codes = q.encode(x, near)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("g"), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "g", "list", "code"])

    kinds = dict(rows.dtypes)
    return stored(rows.mapInArrow(run, f"id {kinds['id']}, g {kinds['g']}, list int, code binary"), "inverted-file")


def _asked(queries: DataFrame, quantizer: Quantizer, group: str) -> DataFrame:
    """id, group, u (unit vector) and lists to probe of every query; stored."""
    shared = queries.sparkSession.sparkContext.broadcast(quantizer)
    rows = queries.select(F.col("entity_id").alias("id"), F.col(group).alias("g"), F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            x = vectors(batch.column("e"), q.dims)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, max(v.shape[1], 1), dtype=np.int32)[: len(v) + 1] if v.shape[1] else np.zeros(len(v) + 1, np.int32)), pa.array(v.ravel())) for v in (x, q.probed(x))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("g"), *lists], ["id", "g", "u", "lists"])

    kinds = dict(rows.dtypes)
    return stored(rows.mapInArrow(run, f"id {kinds['id']}, g {kinds['g']}, u array<float>, lists array<int>"), "probes")


def _match(quantizer: Quantizer) -> blocks.Match:
    """The best of a block by decoded codes, depth for each query; equal ones by id, as equal vectors have equal codes."""

    def match(asked: pa.Table, codes: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        codes = codes.take(pc.sort_indices(codes["id"]))
        lists, found = codes["list"].to_numpy(), []
        x = quantizer.decode(lists, np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(lists), len(quantizer.books)))
        u, probes = blocks.lists(asked, "u")[0].reshape(asked.num_rows, -1), blocks.lists(asked, "lists")[0].reshape(asked.num_rows, -1)
        order = np.argsort(lists, kind="stable")
        present, first = np.unique(lists[order], return_index=True)
        bounds = np.append(first, len(order))
        for low in range(0, len(u), STEP):
            part, wanted = u[low : low + STEP], probes[low : low + STEP]
            score = np.full((len(part), len(x)), -np.inf, np.float32)
            for i, name in enumerate(present.tolist()):
                rows, who = order[bounds[i] : bounds[i + 1]], np.flatnonzero((wanted == name).any(1))
                if len(who):
                    score[np.ix_(who, rows)] = part[who] @ x[rows].T
            kept = min(quantizer.depth, score.shape[1])
            least = np.partition(score, -kept, axis=1)[:, -kept]
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            s = score[i, j]
            ranked = np.lexsort((j, -s, i))
            i, j, s = i[ranked], j[ranked], s[ranked]
            first_of = np.arange(len(i)) - np.searchsorted(i, i) < kept
            found.append((i[first_of] + low, j[first_of], s[first_of]))
        i, j, s = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.table({"s1_id": asked["id"].take(pa.array(i)), "cand_id": codes["id"].take(pa.array(j)), "rough": pa.array(s.astype(np.float64))})

    return match


def compared(queries: DataFrame, pool: DataFrame, quantizer: Quantizer, group: str = "country_norm") -> DataFrame:
    """(s1_id, cand_id): the depth best of each query by their codes."""
    codes, asked = index(pool, quantizer, group), _asked(queries, quantizer, group)
    sizes = codes.groupBy("g", "list").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = stored(sizes.select("g", "list", F.struct("g", F.floor(before / CELL).alias("part")).alias("cell")), "cells")
    few = cells.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS
    side = F.broadcast(cells) if few else cells.hint("merge")
    right = codes.join(side, ["g", "list"]).select("id", F.col("cell").alias("cell"), "list", "code")
    probes = asked.select("id", "g", F.explode("lists").alias("list")).join(side, ["g", "list"]).select("id", "cell").distinct()
    left = probes.join(asked.select("id", "u", "lists"), "id").select("id", F.col("cell").alias("cell"), "u", "lists")
    kind = dict(codes.dtypes)["id"]
    found = blocks.meet(left, right, "cell", _match(quantizer), f"s1_id {kind}, cand_id {kind}, rough double", left_rows=ASKED, right_rows=CELL)
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("rough"), "cand_id"))
    return found.withColumn("_r", place).filter(F.col("_r") <= quantizer.depth).select("s1_id", "cand_id")


def top_k(queries: DataFrame, pool: DataFrame, *, k: int, group: str = "country_norm", seed: int = 42, quantizer: Quantizer | None = None) -> DataFrame:
    """(s1_id, cand_id, score, rank): the k largest inner products of unit vectors within the group among those that the codes bring up; ties to the smaller id.

    queries and pool: entity_id, group, embedding; ids are distinct on each side. Null groups meet nothing; null components and vectors that aren't finite count as zeros; an empty side gives
    no rows. Fewer than k remain only where the lists that a query probes hold fewer.
    """
    quantizer = quantizer or fit(pool, k=k, group=group, seed=seed)
    pairs = stored(compared(queries, pool, quantizer, group), "compared")
    clean = lambda df, name, vec: df.select(F.col("entity_id").alias(name), F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias(vec))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    size = norm("u") * norm("v")
    score = F.coalesce(F.when(size > 0, dot / size), F.lit(0.0))
    # Vectors as they are, floats as a rule, go with the pairs of their query, not the other way round.
    scored = pairs.join(clean(pool, "cand_id", "v").hint("merge"), "cand_id").join(clean(queries, "s1_id", "u").hint("merge"), "s1_id").select("s1_id", "cand_id", F.round(F.when(F.isnan(score), 0.0).otherwise(score), 5).alias("score"))
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
    return scored.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)

"""Nearest neighbours of dense vectors, and Jaccard candidates by MinHash bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.operators import blocks
from kinmesh.sources.writers import stored

THRESHOLD = 0.3


def band_rows(threshold: float, permutations: int) -> int:
    """Rows a band for which two sets of that similarity are as likely found as not: the r with (1/b) ** (1/r) nearest, b bands of r rows."""
    return min(range(1, permutations + 1), key=lambda r: (abs((r / permutations) ** (1 / r) - threshold), r))


#: Query vectors are broadcast up to this number (8 bytes a dimension each).
BROADCAST_QUERIES = 20_000


def with_unit(df: DataFrame, vector: str, name: str) -> DataFrame:
    """df plus the vector at length 1, in double."""
    v = F.transform(vector, lambda x: x.cast("double"))
    df = df.withColumn("_norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))
    return df.withColumn(name, F.transform(vector, lambda x: F.when(F.col("_norm") > 0, x.cast("double") / F.col("_norm")).otherwise(F.lit(0.0)))).drop("_norm")


def dense_top_k(queries: DataFrame, pool: DataFrame, *, k: int, group: str = "country_norm", places: int = 5) -> DataFrame:
    """(s1_id, cand_id, score, rank): the k largest inner products of unit vectors within the group. Exact.

    queries and pool: entity_id, group, embedding. Ties go to the smaller id.
    """
    a = with_unit(queries, "embedding", "u").select(F.col("entity_id").alias("s1_id"), group, "u")
    b = with_unit(pool, "embedding", "v").select(F.col("entity_id").alias("cand_id"), group, "v")
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = a.join(b, group).select("s1_id", "cand_id", F.round(dot, places).alias("score"))
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
    return scored.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)


def dense_probe(queries: DataFrame, pool: DataFrame, *, k: int, group: str = "country_norm", planes: int = 4, tables: int = 12, seed: int = 42, dims: int | None = None) -> DataFrame:
    """Approximate: candidates of the query's group whose signs on seeded hyperplanes differ from the query's in one at most, in one
    table at least; of these the k nearest. Fewer than k remain only where fewer were found. Ids are distinct on each side."""
    if planes * tables > 62:
        raise ValueError("the signs of all tables share one 64-bit number")
    dims = dims or pool.select(F.size("embedding").alias("n")).first()["n"]
    direction = lambda t, p, i: F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.lit(p), i), F.lit(2001)) - 1000
    mask = (1 << planes) - 1

    def keyed(df: DataFrame, id_name: str, vec: str) -> DataFrame:
        """id, group, and the signs of all tables, without the vector."""
        u = with_unit(df, "embedding", vec)
        bit = lambda n: F.when(F.aggregate(F.zip_with(vec, F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: direction(n // planes, n % planes, i)), lambda x, d: x * d), F.lit(0.0), lambda s, x: s + x) > 0, F.lit(1 << n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        signs = sum((bit(n) for n in range(1, planes * tables)), bit(0))
        u = u.select(F.col("entity_id").alias(id_name), group, signs.alias(f"{vec}_signs")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
        return u.withColumn("code", F.expr(f"int(shiftright({vec}_signs, t * {planes}) & {mask})"))

    # The query's own bucket and those across one plane.
    probes = keyed(queries, "s1_id", "u").withColumn("code", F.explode(F.array("code", *(F.col("code").bitwiseXOR(F.lit(1 << p)) for p in range(planes)))))
    met = probes.join(keyed(pool, "cand_id", "v"), [group, "t", "code"])
    # Only the first table in which two meet brings them together, so that no pair comes twice.
    for n in range(tables - 1):
        met = met.filter(F.expr(f"t <= {n} OR bit_count(shiftright(u_signs ^ v_signs, {n * planes}) & {mask}) > 1"))
    pairs = met.select("s1_id", "cand_id")
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    left, right = with_unit(queries, "embedding", "u").select(F.col("entity_id").alias("s1_id"), "u"), with_unit(pool, "embedding", "v").select(F.col("entity_id").alias("cand_id"), "v")
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(right, "cand_id").join(F.broadcast(left) if few else left, "s1_id").select("s1_id", "cand_id", F.round(dot, 5).alias("score"))
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
    return scored.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text has none, and is found by nobody."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<string>"))


def _hashes(grams: Column) -> Column:
    return F.transform(grams, lambda x: F.xxhash64(x))


#: Records whose least hashes are taken at a time.
ROWS = 128


def _hash_int(seeds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """xxhash64(x, number) as Spark has it, for the values xxhash64(x) of strings; a row for each, a column for each number."""
    u = np.uint64
    h = (seeds.view(u)[:, None] + u(0x27D4EB2F165667C5 + 4)) ^ (numbers.astype(u) * u(0x9E3779B185EBCA87))
    h = ((h << u(23)) | (h >> u(41))) * u(0xC2B2AE3D27D4EB4F) + u(0x165667B19E3779F9)
    h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
    return (h ^ (h >> u(32))).view(np.int64)


def least_hashes(values: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """A row for each record: the least hash of its values, none of which has none, under each of the seeds. A value is hashed once a batch."""
    out, numbers = np.empty((len(starts) - 1, permutations), np.int64), np.arange(permutations)
    known, at = np.unique(values, return_inverse=True)
    hashed = np.concatenate([_hash_int(known[i : i + 4096], numbers) for i in range(0, len(known), 4096)]) if len(known) else np.empty((0, permutations), np.int64)
    for low in range(0, len(out), ROWS):
        ends = starts[low : low + ROWS + 1]
        out[low : low + ROWS] = np.minimum.reduceat(hashed[at[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)
    return out


def minhash(records: DataFrame, *, text: str = "combined", permutations: int = 128, ngram: int = 3) -> DataFrame:
    """(entity_id, country_norm, signature): the least hash of the shingles under each of the seeds. Shingles are hashed where the record is, and not shuffled."""
    sets = records.groupBy("entity_id", "country_norm").agg(F.collect_list(text).alias("t"))
    grams = F.array_distinct(F.flatten(F.transform("t", lambda x: shingles(x, ngram))))
    sets = sets.select("entity_id", "country_norm", _hashes(grams).alias("h")).filter(F.size("h") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = least_hashes(*blocks.lists(pa.Table.from_batches([b]), "h"), permutations)
            rows = pa.ListArray.from_arrays(np.arange(len(least) + 1, dtype=np.int32) * permutations, least.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], ["entity_id", "country_norm", "signature"])

    kind = {f.name: f.dataType.simpleString() for f in sets.schema}
    return sets.mapInArrow(run, f"entity_id {kind['entity_id']}, country_norm {kind['country_norm']}, signature array<bigint>")


def with_bands(df: DataFrame, *, text: str, permutations: int, threshold: float, ngram: int) -> DataFrame:
    """(entity_id, country_norm, bands): a hash of each band of the signature, bands as the threshold asks."""
    rows = band_rows(threshold, permutations)
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.get("signature", F.lit(b * rows + i)) for i in range(rows))) for b in range(permutations // rows)))
    return minhash(df, text=text, permutations=permutations, ngram=ngram).select("entity_id", "country_norm", bands.alias("bands"))


#: Records of a block of either side when bands are counted; one's bands take 8 bytes each.
BAND_ROWS = {"left_rows": 65_536, "right_rows": 524_288}


def _most_bands(cap: int | None) -> blocks.Match:
    def match(asked: pa.Table, pool: pa.Table) -> pa.Table:
        (mine, starts), best, found = blocks.lists(asked, "bands"), blocks.Best(asked.num_rows, cap or 0), []
        ones = np.ones(len(mine))
        for places, piece in blocks.pieces(pool):
            theirs, ends = blocks.lists(piece, "bands")
            for low, sums in blocks.Postings(theirs, ends, np.ones(len(theirs))).sums(mine, starts, ones):
                least = 0.5 if cap is None else np.maximum(best.least(low, len(sums)) - 0.5, 0.5)[:, None]
                i, j = np.divmod(np.flatnonzero(sums > least), sums.shape[1])
                n = np.rint(sums[i, j]).astype(np.int64)
                if cap is None:
                    found.append((i + low, places[j], n))
                else:
                    best.add(low, i, places[j], n)
        i, j, n = best.found() if cap is not None else (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"s1_id": asked["id"].take(pa.array(i)), "cand_id": pool["id"].take(pa.array(blocks.by_id(pool)[j])), "bands": n})

    return match


def lsh_pairs(s1: DataFrame, pool: DataFrame, *, text: str = "combined", permutations: int = 128, threshold: float = THRESHOLD, cap: int | None = 100, ngram: int = 3, **size: int) -> DataFrame:
    """(s1_id, cand_id, bands): pairs of a country with a band of signature values in common, bands as the threshold asks; of each query the cap with most
    bands, ties to the smaller id. Bands in common are counted block by block, where a band that very many records share is a row of a matrix; only what
    a block leaves of each query within the cap is shuffled. Of the pool a block is large, so that there are few of them, and is taken in pieces."""

    def side(df: DataFrame, name: str) -> DataFrame:
        found = with_bands(df, text=text, permutations=permutations, threshold=threshold, ngram=ngram)
        return stored(found.select(F.col("entity_id").alias("id"), "country_norm", "bands"), name)

    pairs = blocks.meet(side(s1, "left"), side(pool, "right"), "country_norm", _most_bands(cap), "s1_id string, cand_id string, bands long", **(BAND_ROWS if cap is not None else {}) | size)
    if cap is None:
        return pairs
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("bands"), "cand_id"))
    return pairs.withColumn("_r", place).filter(F.col("_r") <= cap).drop("_r")


#: Bits of a set's sketch: for each, whether an odd number of members falls on it.
BITS = 256


def sketches(sets: DataFrame, permutations: int, rows: int) -> DataFrame:
    """sets (id, country_norm, text, h) with n (members), bits and bands in place of h, the hashes of the members; records without members go.

    Sets differ in as many members at least as their bits. bands: 32 bits of each band of rows least hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, starts = blocks.lists(pa.Table.from_batches([b]), "h")
            n, sizes = len(starts) - 1, np.diff(starts)
            odd = np.bincount(np.repeat(np.arange(n), sizes) * BITS + (h & (BITS - 1)), minlength=n * BITS) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1)
            least, bands = least_hashes(h, starts, permutations), np.zeros((n, permutations // rows), np.int64)
            for i in range(rows):
                bands = _hash_int((bands ^ least[:, i : permutations // rows * rows : rows]).ravel(), np.array([i])).reshape(bands.shape)
            bands = (bands & 0xFFFFFFFF).astype(np.uint32)
            raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (bits, bands)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "country_norm", "text")), pa.array(sizes, pa.int32()), *raw], ["id", "country_norm", "text", "n", "bits", "bands"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.filter(F.size("h") > 0).mapInArrow(run, f"id {kind}, country_norm string, text string, n int, bits binary, bands binary")


def _alike(at_least: float, ngram: int) -> blocks.Match:
    """Pairs with a band in common and that Jaccard similarity at least.

    Pairs are met band by band. Two such sets differ in (1 - at_least) / (1 + at_least) of their members together at most, so in no more bits of their sketches;
    the few pairs that pass this are compared by whole sets.
    """
    share = (1 - at_least) / (1 + at_least)

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits, bands = (np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(t.num_rows, -1) for c, kind in (("bits", np.uint64), ("bands", np.uint32)))
        return t["n"].to_numpy().astype(np.int64), np.ascontiguousarray(bits.T), np.ascontiguousarray(bands.T)

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        (n_a, bits_a, bands_a), (n_b, bits_b, bands_b) = read(a), read(b)
        met: list[np.ndarray] = []
        for mine, theirs in zip(bands_a, bands_b, strict=True):
            order = np.argsort(theirs, kind="stable")
            theirs, rows = theirs[order], np.argsort(mine, kind="stable")
            first, last = (np.searchsorted(theirs, mine[rows], side) for side in ("left", "right"))
            some = last > first
            rows, first, sizes = rows[some], first[some], (last - first)[some]
            part = np.cumsum(sizes) // blocks.CELLS
            for low, high in _runs(part):
                i = np.repeat(rows[low:high], sizes[low:high])
                j = order[_spans(first[low:high], sizes[low:high])]
                differ = np.zeros(len(i), np.int64)
                for k, (x, y) in enumerate(zip(bits_a, bits_b, strict=True)):
                    differ += np.bitwise_count(x[i] ^ y[j])
                    if k % 2:
                        near = np.flatnonzero(differ <= share * (n_a[i] + n_b[j]) + 1e-9)
                        i, j, differ = i[near], j[near], differ[near]
                met.append(i * len(n_b) + j)
            if sum(map(len, met)) > blocks.CELLS:
                met = [np.unique(np.concatenate(met))]
        i, j = np.divmod(np.unique(np.concatenate([*met, np.zeros(0, np.int64)])), max(len(n_b), 1))
        found = []
        for low, high in _runs(np.cumsum(n_a[i] + n_b[j]) // blocks.CELLS):
            u, v = i[low:high], j[low:high]
            x, y = (_sets(t["text"], w, ngram) for t, w in ((a, u), (b, v)))
            shared = np.array([len(x[p] & y[q]) for p, q in zip(u.tolist(), v.tolist(), strict=True)])
            score = shared / (n_a[u] + n_b[v] - shared)
            kept = score >= at_least
            found.append((u[kept], v[kept], score[kept]))
        i, j, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"s1_id": a["id"].take(pa.array(i)), "cand_id": b["id"].take(pa.array(j)), "score": scores})

    return match


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    return ((x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y)


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as its size, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)


def _sets(texts: pa.ChunkedArray, rows: np.ndarray, ngram: int) -> dict[int, set[str]]:
    rows = np.unique(rows)
    return {i: {t[n : n + ngram] for n in range(len(t) - ngram + 1)} for i, t in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist(), strict=True)}


def lsh_similar(s1: DataFrame, pool: DataFrame, *, at_least: float, text: str = "combined", ngram: int = 3, permutations: int = 128, threshold: float = THRESHOLD, left_rows: int = 32_768, right_rows: int = 65_536) -> DataFrame:
    """(s1_id, cand_id, score): pairs of a country with a band in common, as lsh_pairs finds without its cap, whose sets of shingles have at least that
    Jaccard similarity, to six places. Pairs with a band in common grow with the square of a country, so records meet in blocks, band by band, and pairs
    aren't shuffled; a record's sketch is made once and goes with it."""

    def side(df: DataFrame, name: str) -> DataFrame:
        sets = df.select(F.col("entity_id").alias("id"), "country_norm", F.col(text).alias("text"), _hashes(shingles(F.col(text), ngram)).alias("h"))
        return stored(sketches(sets, permutations, band_rows(threshold, permutations)), name)

    found = blocks.meet(side(s1, "left"), side(pool, "right"), "country_norm", _alike(at_least, ngram), "s1_id string, cand_id string, score double", left_rows=left_rows, right_rows=right_rows)
    return found.withColumn("score", F.round("score", 6))

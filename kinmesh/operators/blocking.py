"""Candidate generation by exact keys and token overlap, union of strategies, pre-filter.

Candidates are long tables (s1_id, cand_id). Every strategy joins on the country as well as its key, so no task
ever holds a country.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.functions import batch
from kinmesh.operators import blocks, features
from kinmesh.sources.writers import stored

PREFIX_LEAST = 3
#: Weights of the cheap score: name and address by Jaro-Winkler, and overlap of name tokens.
CHEAP = (0.45, 0.30, 0.25)
#: First-source records of a key that meet its pool records at a time (on average), records of either side where the key has more in the pool than WIDE, and pairs for each task.
CHUNK, WIDE, TASK_PAIRS = 128, 1_024, 50_000
#: Tasks of a join at most; beyond them a task has more pairs, which it holds only as they leave it.
MOST_TASKS = 10_000
#: What scores and features read of a record.
TEXTS = {"n": "name_clean", "a": "addr_clean"}


def key_columns() -> dict[str, tuple[Column, Column]]:
    """Strategy: (key, whether the record has one)."""
    name, nums, three = F.col("name_clean"), F.col("addr_nums_str"), F.col("name_sorted_3tok")
    long = F.length(name) >= PREFIX_LEAST
    return {
        "prefix5": (F.substring(name, 1, 5), long),
        "prefix4": (F.substring(name, 1, 4), long),
        "sorted3": (three, F.length(three) >= 1),
        "addr_nums": (nums, F.length(nums) >= 1),
    }


def _tags(df: DataFrame, keys: Mapping[str, tuple[Column, Column]], name: str) -> DataFrame:
    """(id, tag) for each key that a record has; a tag is made of the strategy's number, the country and the key, and equal only if all three are."""
    prefix = lambda i: F.concat(F.lit(f"{i}|"), F.length("country_norm").cast("string"), F.lit("|"), F.col("country_norm"))
    tags = F.array(*(F.when(present, F.concat(prefix(i), key)) for i, (key, present) in enumerate(keys.values())))
    return df.select(F.col("entity_id").alias(name), F.explode(tags).alias("tag")).filter("tag IS NOT NULL")


def pairs_on_keys(s1: DataFrame, pool: DataFrame, keys: Mapping[str, tuple[Column, Column]], bounds: Mapping[str, int | None], left: Mapping[str, Column] | None = None, right: Mapping[str, Column] | None = None) -> DataFrame:
    """(s1_id, cand_id, found): each pair with the same country and key of one strategy or more, once; found: those strategies. Of a key's records in the pool the
    first by id are indexed, as many as the strategy's bound. left and right: columns of either side's records that come with the pairs.

    Pairs are neither shuffled nor grouped: both records know all their keys, so a pair comes out under the first key that they share and under no other. A key's records of
    the first source meet the pool's in chunks, of both sides where there is no bound, and there is a task for every TASK_PAIRS pairs.
    """
    spark, bounded = s1.sparkSession, {i: n for i, n in enumerate(bounds[name] for name in keys) if n is not None}
    indexed = _tags(pool, keys, "cand_id")
    if bounded:
        strategy = F.substring_index("tag", "|", 1).cast("int")
        bound = F.coalesce(F.get(F.array(*(F.lit(bounded.get(i)).cast("long") for i in range(len(keys)))), strategy), F.lit(1 << 62))
        place = F.row_number().over(Window.partitionBy("tag").orderBy("cand_id"))
        indexed = indexed.withColumn("_n", place)
        indexed = (indexed.filter(F.col("_n") <= max(bounded.values())) if len(bounded) == len(keys) else indexed).filter(F.col("_n") <= bound).drop("_n")
    of = lambda df, name, tags: df.groupBy(name).agg(F.sort_array(F.collect_set("tag")).alias(tags))

    def side(df: DataFrame, records: DataFrame, name: str, tags: str, more: Mapping[str, Column] | None) -> DataFrame:
        out = of(df, name, tags)
        if more:
            out = out.join(records.select(F.col("entity_id").alias(name), *(c.alias(n) for n, c in more.items())), name)
        return stored(out, name)

    a, b = side(_tags(s1, keys, "s1_id"), s1, "s1_id", "_ta", left), side(indexed, pool, "cand_id", "_tb", right)
    a, b = a.withColumn("tag", F.explode("_ta")), b.withColumn("tag", F.explode("_tb"))
    counts = lambda df, name: df.groupBy("tag").agg(F.count(F.lit(1)).alias(name))
    sizes = counts(a, "_na").join(counts(b, "_nb"), "tag")
    wide = F.col("_nb") > WIDE
    parts = (F.ceil(F.col("_na") / F.when(wide, WIDE).otherwise(CHUNK)).cast("int").alias("_pa"), F.ceil(F.col("_nb") / WIDE).cast("int").alias("_pb"))
    hot = stored(sizes.filter(wide | (F.col("_na") > CHUNK)).select("tag", *parts), "hot")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_na").cast("double") * F.col("_nb")), F.lit(0.0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, min(math.ceil(pairs / TASK_PAIRS), MOST_TASKS))

    def dealt(df: DataFrame, name: str, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        """Each record in its own chunk, once for every chunk of the other side."""
        of = lambda n: F.coalesce(n, F.lit(1))
        df = df.join(hot, "tag", "left").withColumn(own, F.pmod(F.xxhash64(name), of(mine)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), of(theirs) - 1))).drop("_pa", "_pb").repartition(tasks, "tag", "_ca", "_cb")

    met = dealt(a, "s1_id", "_ca", "_pa", "_cb", "_pb").join(dealt(b, "cand_id", "_cb", "_pb", "_ca", "_pa"), ["tag", "_ca", "_cb"])
    names = F.array(*(F.lit(n) for n in keys))
    found = F.transform(F.array_intersect("_ta", "_tb"), lambda t: F.get(names, F.substring_index(t, "|", 1).cast("int")))
    # The first shared key: both lists are sorted. Where either record has one key, they share no other.
    met = met.filter((F.size("_ta") == 1) | (F.size("_tb") == 1) | (F.col("tag") == F.get(F.array_intersect("_ta", "_tb"), F.lit(0))))
    return met.select("s1_id", "cand_id", F.array_distinct(found).alias("found"), *(left or ()), *(right or ()))


def block_on_key(s1: DataFrame, pool: DataFrame, key: Column, present: Column, *, bucket: int | None = 100, probe: int | None = None) -> DataFrame:
    """Pairs with the same key and country. Of a key's records in the pool the first `bucket` by id are indexed; probe is a second, smaller bound."""
    bound = min((x for x in (bucket, probe) if x is not None), default=None)
    return pairs_on_keys(s1, pool, {"key": (key, present)}, {"key": bound}).select("s1_id", "cand_id")


def key_pairs(s1: DataFrame, pool: DataFrame, bucket: int | None = 100, only: str | None = None, *, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(s1_id, cand_id, found) of all key strategies, or one. texts: columns of the records by short names, which come with a 1 for the first source's and a 2 for the pool's."""
    keys = {name: k for name, k in key_columns().items() if only in (None, name)}
    of = lambda i: {f"{n}{i}": F.col(c) for n, c in (texts or {}).items()}
    return pairs_on_keys(s1, pool, keys, dict.fromkeys(keys, bucket), of(1), of(2))


def block_keys(s1: DataFrame, pool: DataFrame, bucket: int = 100) -> dict[str, DataFrame]:
    return {name: key_pairs(s1, pool, bucket, name).select("s1_id", "cand_id") for name in key_columns()}


def block_keys_v1(s1: DataFrame, pool: DataFrame, cap: int = 50) -> dict[str, DataFrame]:
    """First generation: name key, and three address numbers; at most cap records a key. Records as normalise_v1 makes them."""
    nums = F.array_join(F.slice(F.sort_array("addr_nums"), 1, 3), "_")
    return {"name_key": block_on_key(s1, pool, F.col("name_key"), F.col("name_key") != "", bucket=cap), "addr_nums": block_on_key(s1, pool, nums, F.size("addr_nums") > 0, bucket=cap)}


def block_keys_monolith(s1: DataFrame, pool: DataFrame) -> dict[str, DataFrame]:
    """First generation, single file: prefix of five (index unbounded, 50 probed), address numbers (100 indexed, 50 probed)."""
    keys = key_columns()
    return {"prefix5": block_on_key(s1, pool, *keys["prefix5"], bucket=None, probe=50), "addr_nums": block_on_key(s1, pool, *keys["addr_nums"], bucket=100, probe=50)}


def token_overlap(s1: DataFrame, pool: DataFrame, *, names: int = 1, nums: int = 1, left_rows: int = 4096, right_rows: int = 4096) -> DataFrame:
    """Pairs of a country with a name token in common and, where both have address numbers, a number too; else two name tokens.

    Records meet in blocks (`blocks`), which bound what a task finds, and only the pairs that are left leave them.
    """
    side = lambda df: df.filter(F.size("name_tokens") > 0).select(F.col("entity_id").alias("id"), "country_norm", F.array_distinct("name_tokens").alias("t"), F.array_distinct(F.coalesce("addr_nums", F.array().cast("array<string>"))).alias("n"))

    def common(a: pa.Table, b: pa.Table, column: str) -> Iterator[tuple[int, np.ndarray]]:
        (x, x_starts), (y, y_starts) = blocks.lists(a, column), blocks.lists(b, column)
        codes = pa.array(np.concatenate([x, y]), pa.string()).dictionary_encode().indices.to_numpy()
        postings = blocks.Postings(codes[len(x) :], y_starts, np.ones(len(y)))
        return postings.sums(codes[: len(x)], x_starts, np.ones(len(x)))

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        with_a, with_b = (np.diff(blocks.lists(t, "n")[1]) > 0 for t in (a, b))
        found = []
        for (low, n), (_, m) in zip(common(a, b, "t"), common(a, b, "n"), strict=True):
            both = with_a[low : low + len(n), None] & with_b
            i, j = np.divmod(np.flatnonzero(np.where(both, (n >= names) & (m >= nums), n >= names + 1)), len(with_b))
            found.append(((i + low).astype(np.int32), j.astype(np.int32)))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"s1_id": a["id"].take(pa.array(i)), "cand_id": b["id"].take(pa.array(j))})

    left, right = stored(side(s1), "left"), stored(side(pool), "right")
    return blocks.meet(left, right, "country_norm", match, "s1_id string, cand_id string", left_rows=left_rows, right_rows=right_rows)


def tagged(strategies: Mapping[str, DataFrame]) -> DataFrame:
    """(strategy, s1_id, cand_id) of all strategies."""
    parts: Iterator[DataFrame] = (df.select(F.lit(name).alias("strategy"), "s1_id", "cand_id") for name, df in strategies.items())
    out = next(parts)
    for p in parts:
        out = out.unionByName(p)
    return out


def union(strategies: Mapping[str, DataFrame]) -> DataFrame:
    return tagged(strategies).select("s1_id", "cand_id").distinct()


def pair_texts(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """pairs plus n1, a1 (of the first source's record) and n2, a2; pairs whose records are unknown go."""
    left = s1.select(F.col("entity_id").alias("s1_id"), F.col("name_clean").alias("n1"), F.col("addr_clean").alias("a1"))
    right = pool.select(F.col("entity_id").alias("cand_id"), F.col("name_clean").alias("n2"), F.col("addr_clean").alias("a2"))
    return pairs.join(left, "s1_id").join(right, "cand_id")


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(batch.jaro_winkler(a.tolist(), b.tolist()))


@F.pandas_udf(T.DoubleType())
def token_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens in common over those of the smaller set; a batch's texts are cut up once each. Two empty sets are alike, one empty is unlike."""
    sides = (features.token_sets(x.tolist()) for x in (a, b))
    return pd.Series([len(x & y) / min(len(x), len(y)) if x and y else float(not x and not y) for x, y in zip(*sides, strict=True)], dtype=float)


def cheap_score(texts: DataFrame) -> DataFrame:
    """texts (n1, a1, n2, a2) plus score to six places, by which pairs are ranked and cut. Two empty texts or token sets are alike, one empty is unlike."""
    score = CHEAP[0] * jaro_winkler("n1", "n2") + CHEAP[1] * jaro_winkler("a1", "a2") + CHEAP[2] * token_share("n1", "n2")
    # Rounded as SQL does, in binary; F.round to six places goes by the decimal digits.
    return texts.withColumn("score", F.round(score * 1e6, 0) / 1e6)


def prefilter(pairs: DataFrame, s1: DataFrame, pool: DataFrame, *, cap: int = 100, min_score: float = 0.15) -> DataFrame:
    """Entities with more than cap candidates keep the best cap of those that reach min_score; others keep all theirs.

    Ties go to the smaller id. Only crowded entities' pairs are scored.
    """
    counted = pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("s1_id")))
    few = counted.filter(F.col("_n") <= cap).select("s1_id", "cand_id")
    return few.unionByName(_best(pair_texts(counted.filter(F.col("_n") > cap).select("s1_id", "cand_id"), s1, pool), cap, min_score))


def _best(texts: DataFrame, cap: int, min_score: float) -> DataFrame:
    scored = cheap_score(texts).filter(F.col("score") >= min_score)
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
    return scored.select("s1_id", "cand_id", place.alias("_r")).filter(F.col("_r") <= cap).select("s1_id", "cand_id")


def prefilter_on_keys(s1: DataFrame, pool: DataFrame, *, cap: int = 100, min_score: float = 0.15, bucket: int | None = 100) -> DataFrame:
    """prefilter() over the union of the key strategies. Candidates are counted first, so that the texts of crowded entities come with their pairs and no pair is looked up."""
    crowded = key_pairs(s1, pool, bucket).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select(F.col("s1_id").alias("entity_id"))
    crowded = stored(crowded, "crowded")
    few = key_pairs(s1.join(crowded, "entity_id", "left_anti"), pool, bucket).select("s1_id", "cand_id")
    return few.unionByName(_best(key_pairs(s1.join(crowded, "entity_id", "left_semi"), pool, bucket, texts=TEXTS), cap, min_score))


def ranked_candidates(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """pairs plus score (6 places) and rank by it: one ranking serves every cap."""
    return ranked(pair_texts(pairs, s1, pool))


def ranked(texts: DataFrame) -> DataFrame:
    """s1_id, cand_id, score and rank of pairs with their texts."""
    scored = cheap_score(texts)
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id"))
    return scored.select("s1_id", "cand_id", "score", place.cast("bigint").alias("rank"))

"""Samples. Orders are by a digest of id and seed, so that they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.sources.readers import first_records


def shuffled(id_col: str, seed: int) -> Column:
    """Place in a seeded order that SQL engines agree on."""
    return F.md5(F.concat(F.col(id_col), F.lit(f"|{seed}")))


def sample_ids(records: DataFrame, n: int, seed: int) -> DataFrame:
    """n records without replacement."""
    return records.orderBy(shuffled("entity_id", seed), "entity_id").limit(n)


def sample_pool(pool: DataFrame, must: DataFrame, extra: int | None, seed: int) -> DataFrame:
    """Every must-have record and, for each country, up to extra others: lower source numbers first, in seeded order within.

    extra None takes all. must: column entity_id. Ids are unique in the result.
    """
    pool = first_records(pool)
    if extra is None:
        return pool
    needed = pool.join(must.select("entity_id").distinct(), "entity_id", "left_semi")
    others = pool.join(must.select("entity_id").distinct(), "entity_id", "left_anti")
    by = Window.partitionBy("country_norm").orderBy(F.substring("entity_id", 1, 2), shuffled("entity_id", seed), "entity_id")
    return needed.unionByName(others.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= extra).drop("_n"))


def quota_pool_v1(pool: DataFrame, must: DataFrame, sample_size: int, seed: int) -> DataFrame:
    """First generation: every must-have record and, for each country, max(10 n, 50,000) others."""
    return sample_pool(pool, must, max(10 * sample_size, 50_000), seed)


def bernoulli_pool(pool: DataFrame, must: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Every must-have record and each other one with the given chance."""
    flagged = pool.join(must.select("entity_id", F.lit(True).alias("_must")).distinct(), "entity_id", "left")
    chance = F.conv(F.substring(shuffled("entity_id", seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return flagged.filter(F.coalesce("_must", F.lit(False)) | (chance < fraction)).drop("_must")


def restrict_to_countries(pool: DataFrame, sample: DataFrame) -> DataFrame:
    return pool.join(sample.select("country_norm").distinct(), "country_norm", "left_semi")

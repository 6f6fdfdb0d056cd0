"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an offset and a step, both
from a digest of its name). Shards take turns; at its turn a shard claims the first free slot of its
order, or as many as its weight. The full table is a constant of the plan: a document's key is hashed
to a slot and the broadcast table names the shard, so placement needs no shuffle and one lookup.
When a shard joins or leaves, nearly all other documents stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default size of the table. A prime, so that every step visits all slots; bounds the broadcast at 1 MB.
SLOTS = 65_537
SHARDS = 64


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(names: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """slots entries, each the index of a shard in names. weights: how many slots a shard claims at a turn."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, and one at least")
    if not _is_prime(slots) or slots < len(names):
        raise ValueError("the number of slots must be a prime and no smaller than the number of shards")
    turns = list(weights or [1] * len(names))
    if len(turns) != len(names) or min(turns) < 1:
        raise ValueError("each shard needs a weight of one or more")
    at = [_digest(f"{name}|offset") % slots for name in names]
    step = [_digest(f"{name}|step") % (slots - 1) + 1 for name in names]
    filled, left = [-1] * slots, slots
    while True:
        for shard, claims in enumerate(turns):
            for _ in range(claims):
                slot = at[shard]
                while filled[slot] >= 0:
                    slot = (slot + step[shard]) % slots
                filled[slot] = shard
                at[shard] = (slot + step[shard]) % slots
                left -= 1
                if not left:
                    return filled


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key of any type; a null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots).cast("bigint"))


def table_frame(spark: SparkSession, filled: Sequence[int]) -> DataFrame:
    """The table as (slot, shard); slots rows by construction, so its size is bounded by a parameter."""
    entries = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<int>")
    exploded = spark.range(1).select(F.posexplode(entries).alias("_km_slot", "_km_shard"))
    return exploded.select(F.col("_km_slot").cast("bigint").alias("_km_slot"), F.col("_km_shard").cast("bigint").alias("_km_shard"))


def place(df: DataFrame, names: Sequence[str], *, key: str = "doc_id", slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """All rows and columns of df, plus shard (index in names).

    Rows with the same key share a shard; a null key is placed as the empty string. An empty table
    gives an empty table. A column named shard in df is replaced; all others keep their values, whatever their names.
    """
    spark = df.sparkSession
    filled = table_frame(spark, lookup_table(names, slots, weights))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != "shard"]
    hidden = df.select(*([F.struct(*kept).alias("_km_row")] if kept else []), slot_of(F.col(f"`{key}`"), slots).alias("_km_at"))
    placed = hidden.join(F.broadcast(filled), F.col("_km_at") == F.col("_km_slot"))
    return placed.select(*(["_km_row.*"] if kept else []), F.col("_km_shard").alias("shard"))


def write_shards(placed: DataFrame, path: str, *, files_per_shard: int = 8, key: str = "doc_id") -> None:
    """Writes one folder a shard. Rows of a shard are dealt over several files, so that no shard is one task.

    All rows are written, repeated ones too; those with the same key share a file, a null key counts as a key; an empty table makes no folder.
    """
    salt = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmesh.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, shard_names()).select("doc_id", slot_of(F.col("doc_id")).alias("slot"), "shard")


def oracle() -> str:
    listed = ",".join(map(str, lookup_table(shard_names())))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS}"
    return f"WITH t AS MATERIALIZED (SELECT [{listed}] AS l), d AS (SELECT doc_id, {slot} AS slot FROM documents) SELECT doc_id, slot, CAST(l[slot + 1] AS BIGINT) AS shard FROM d, t"

"""Matches of newly arriving secondary records against a stored first source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinmesh.config import Config
from kinmesh.functions.text import normalise
from kinmesh.operators import blocking, decide


def match_stream(stream: DataFrame, s1: DataFrame, scorer, out: str, checkpoint: str, *, threshold: float, config: Config | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of raw records (entity_id, business_name, business_address, country) is normalised, blocked against
    s1 by exact keys, scored by scorer(texts) -> (s1_id, cand_id, p) and decided; matches go to out/batch=<id>, so that a repeated
    batch replaces its own rows. Ownership is decided within a batch: a record arrives once.
    """
    config = config or Config()

    def one_batch(batch: DataFrame, number: int) -> None:
        pool = normalise(batch.dropDuplicates(["entity_id"]))
        pairs = blocking.union(blocking.block_keys(s1, pool, config.key_bucket))
        matches = decide.decide(scorer(blocking.pair_texts(pairs, s1, pool)), threshold, one_to_one=config.one_to_one, singleton_best=config.singleton_best)
        matches.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def model_scorer(models: list):
    """A scorer from fitted models."""
    from kinmesh.operators import features, training

    def score(texts: DataFrame) -> DataFrame:
        return training.predict(training.assembled(features.pair_features(texts), features.FEATURE_NAMES), models).select("s1_id", "cand_id", "p")

    return score

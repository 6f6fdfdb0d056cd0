"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of docs. run() writes each stage's rows to the shared folder and reads them back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmesh.llm import decontam, mixing, neardup, quality, sharding
from kinmesh.llm.common import stored, table

#: Share of the tokens that reach the mixing stage which it keeps; it takes no document twice.
SHARE, MAX_EPOCHS = 0.6, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules certified on the labels of sf_dir.

    Null, empty and short texts fail the base rule and go; very long texts are judged whole; rows that are alike are judged alike and
    all kept; an empty table stays empty; further columns stay, whatever their names.
    """
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (80 %).

    Null, empty and blank texts and rows without an id are in no group and stay; rows with the same id are one document and stay or go
    together; an empty table stays empty; further columns stay.
    """
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark of sf_dir.

    Null and empty texts have no words and stay; very long texts are scanned whole; repeated rows stay or go alike; with an empty
    benchmark all stay; an empty table stays empty; further columns stay.
    """
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SHARE of the tokens, dealt out over domains, languages and sources by their weights, no document twice.

    Null languages and sources count as empty names; null texts have no tokens and go where their leaf's prefix puts them; rows with the same
    id stand at the same place; an empty table stays empty; further columns stay.
    """
    return mixing.mix(docs, share=SHARE, max_epochs=MAX_EPOCHS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number of their shard, by id; a null id counts as the empty text, rows with the same id share a shard, a column
    named shard is replaced; an empty table stays empty."""
    return sharding.place(docs, sharding.shard_names())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Near duplicates are components of a similarity join, which SQL can't express at any useful size; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

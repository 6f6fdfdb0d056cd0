"""Scans of record tables, ground truth, ids, caches and models."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.config import PREPROCESS_VERSION
from kinmesh.functions.text import country_norm, normalise
from kinmesh.functions.text_v1 import chain_normalise, normalise_v1

_text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
RECORD_SCHEMA = _text("entity_id", "business_name", "business_address", "country")
TRUTH_SCHEMA = _text("source1_entity_id", "matched_entity_ids")
# Field texts that count as missing, in exactly this spelling.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _present(name: str) -> Column:
    return F.when(~F.col(name).isin(*MISSING), F.col(name)).alias(name)


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Tab-separated text with a header and quoted fields; every column a string, MISSING texts as null."""
    raw = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=False, enforceSchema=True)
    return raw.select(*(_present(n) for n in schema.names))


def load_source(spark: SparkSession, path: str | list[str], *, generation: int = 2, transliterate: bool = True) -> DataFrame:
    """Records, normalised: generation 2 is current, 1 the chain of replacements, 0 the first modular variant."""
    records = read_tsv(spark, path)
    return {2: lambda: normalise(records, transliterate=transliterate), 1: lambda: chain_normalise(records), 0: lambda: normalise_v1(records)}[generation]()


def load_sources(spark: SparkSession, *paths: str, **how: object) -> list[DataFrame]:
    """One lazy frame for each path, in order; Spark reads them in parallel when they are used."""
    return [load_source(spark, p, **how) for p in paths]


def load_country(spark: SparkSession, path: str, country: str, keep: Column | None = None, *, transliterate: bool = True) -> DataFrame:
    """Records of one country, the filter standing before normalisation."""
    rows = read_tsv(spark, path).filter(country_norm(F.col("country")) == country.strip().lower())
    return normalise(rows if keep is None else rows.filter(keep), transliterate=transliterate)


def parse_truth(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_id), one row for each true match; records without matches have no row."""
    pairs = truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("cand_id"))
    return pairs.filter("cand_id <> ''").distinct()


def truth_entities(truth: DataFrame) -> DataFrame:
    """All records of the ground truth, singletons included."""
    return truth.select(F.col("source1_entity_id").alias("s1_id")).distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path).select("entity_id").filter("entity_id IS NOT NULL")


def first_records(records: DataFrame, *order: str) -> DataFrame:
    """One record an id: the least by the columns of order and then by all others, so that every branch of a plan has the same one."""
    rest = [c for c in records.columns if c not in (*order, "entity_id")]
    least = records.groupBy("entity_id").agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return least.select(*(F.col(c) if c == "entity_id" else F.col(f"_first.{c}") for c in records.columns))


def union_pool(*sources: DataFrame) -> DataFrame:
    """Secondary sources as one pool; of an id in several, the record of the first source stays."""
    out = sources[0].withColumn("_source", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("_source", F.lit(i)))
    return first_records(out, "_source").drop("_source")


def load_model(spark: SparkSession, path: str, feature_names: list[str]):
    """(models, threshold) as sinks.save_model wrote them; refused if made for other preprocessing or features."""
    from pyspark.ml.classification import GBTClassificationModel

    from kinmesh.operators.boosting import Boosted

    side = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/sidecar").collect()))
    if side["preprocess_version"] != PREPROCESS_VERSION:
        raise ValueError(f"the model expects preprocessing version {side['preprocess_version']}, this is {PREPROCESS_VERSION}")
    if side["feature_names"] != list(feature_names):
        raise ValueError("the model was trained on other features")
    kinds = side.get("kinds", ["spark"] * side["models"])
    return [Boosted.from_frame(spark.read.parquet(f"{path}/model-{i}")) if kind == "nodes" else GBTClassificationModel.load(f"{path}/model-{i}") for i, kind in enumerate(kinds)], side["threshold"]

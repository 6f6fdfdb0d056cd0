"""TF-IDF indexes kept in a folder: saved once, extended by segments, asked without fitting anew.

    path/sidecar          what load() checks, written last: without it there is no index
    path/vocabulary       term, number, df, idf
    path/segments/<name>  id, country, numbers, weights, in order of country and id

The vocabulary and its idf stay as they were fitted, so scores of records that are there don't change when others come. One append at a time.
A segment counts once it is finished; what a lost run has left behind is passed over. An index of many small segments is written whole again by save(load(...), elsewhere).
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.config import PREPROCESS_VERSION
from kinmesh.operators import tfidf
from kinmesh.sources import writers

LAYOUT = 1
TERMS = {"char": tfidf.char_terms, "word": tfidf.word_terms}
#: Groups asked for are named to the scan up to this number, which skips what holds none of them; beyond it all is read.
NAMED_GROUPS = 1000


def save(index: tfidf.Index, path: str) -> None:
    """Refused where there is an index already, and for terms that a sidecar can't name."""
    spark = index.vocabulary.sparkSession
    kinds = [k for k, terms in TERMS.items() if terms is index.terms]
    if not kinds:
        raise ValueError(f"only indexes of {' or '.join(TERMS)} terms can be saved")
    if writers.exists(spark, f"{path}/sidecar/_SUCCESS"):
        raise ValueError(f"there is an index in {path}")
    writers.clear(spark, path)
    index.vocabulary.write.parquet(f"{path}/vocabulary")
    _write(index.vectors if index.kept else writers.stored(index.vectors, "vectors"), f"{path}/segments/0")
    side = {"layout": LAYOUT, "preprocess_version": PREPROCESS_VERSION, "kind": kinds[0], "text": index.text, "few": index.few}
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.text(f"{path}/sidecar")


def _write(vectors: DataFrame, path: str) -> None:
    vectors.repartitionByRange("country", "id").sortWithinPartitions("country", "id").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tfidf.Index:
    """As save() and append() left it; refused without a sidecar, or if made for another layout or other preprocessing."""
    if not writers.exists(spark, f"{path}/sidecar/_SUCCESS"):
        raise ValueError(f"there is no finished index in {path}")
    side = json.loads(spark.read.text(f"{path}/sidecar").first()["value"])
    if (side["layout"], side["preprocess_version"]) != (LAYOUT, PREPROCESS_VERSION):
        raise ValueError(f"the index expects layout {side['layout']} and preprocessing version {side['preprocess_version']}, this is {LAYOUT} and {PREPROCESS_VERSION}")
    vectors = spark.read.parquet(*writers.segments(spark, f"{path}/segments"))
    return tfidf.Index(spark.read.parquet(f"{path}/vocabulary"), vectors, TERMS[side["kind"]], side["few"], side["text"], True)


def append(records: DataFrame, path: str, *, segment: str | None = None) -> None:
    """records (entity_id, country_norm and the index's text) as one more segment. Terms outside the vocabulary don't count; a record without any that
    does has no vector, as when fitting. Records whose id and country (null being a value here) another segment has are left out, so a call can be repeated.

    segment: a name of the caller's, such as a batch's number; the segment of that name is replaced. A new one by default.
    """
    spark = records.sparkSession
    index, name = load(spark, path), segment or f"segment-{uuid.uuid4().hex}"
    texts = tfidf._texts(records, index.text)
    others = [p for p in writers.segments(spark, f"{path}/segments") if p.rpartition("/")[2] != name]
    if others:
        known = spark.read.parquet(*others).select("id", "country")
        texts = texts.join(known, F.col("doc_id").eqNullSafe(known["id"]) & texts["country"].eqNullSafe(known["country"]), "left_anti")
    _write(writers.stored(tfidf._pool(texts, index.terms, index.vocabulary, index.few), "vectors"), f"{path}/segments/{name}")


def query(s1: DataFrame, path: str, *, k: int, **size: int) -> DataFrame:
    """tfidf.query on the index in path; of the segments only what holds a country of s1's is read, where those are few."""
    index = load(s1.sparkSession, path)
    asked = [r["country_norm"] for r in s1.select("country_norm").distinct().limit(NAMED_GROUPS + 1).collect()]
    if len(asked) <= NAMED_GROUPS:
        index = dataclasses.replace(index, vectors=index.vectors.filter(F.col("country").isin([c for c in asked if c is not None])))
    return tfidf.query(s1, index, k=k, **size)

"""Approximate neighbours: recall against exact ones, work done, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmesh.config import Config
from kinmesh.operators import blocks, ivf, neighbours
from kinmesh.plans import linkage, queries

SF = "/root/testdata/sf0.1"


def frame(spark, x, groups):
    return spark.createDataFrame([(f"p{i:05d}", g, v) for i, (v, g) in enumerate(zip(x.astype(float).tolist(), groups, strict=True))], "entity_id string, country_norm string, embedding array<float>").repartition(4)


def drawn(kind, n=6000, d=32):
    rng = np.random.default_rng(11)
    if kind == "clusters":
        return rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, d))
    return rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["clusters", "none"])
def test_recall_and_work(spark, kind):
    x = drawn(kind)
    pool = frame(spark, x, ["a" if i % 3 else "b" for i in range(len(x))]).cache()
    asked = pool.filter(F.substring("entity_id", 2, 5).cast("int") % 50 == 0)
    q = ivf.fit(pool, k=10)
    exact = neighbours.dense_top_k(asked, pool, k=10)
    near = ivf.top_k(asked, pool, k=10, quantizer=q).cache()
    assert near.count() == exact.count()
    assert exact.join(near, ["s1_id", "cand_id"], "left_semi").count() >= 0.95 * exact.count()
    both = exact.join(near.withColumnRenamed("score", "other"), ["s1_id", "cand_id"])
    assert both.filter("score <> other").isEmpty()
    pairs = asked.groupBy("country_norm").count().join(pool.groupBy("country_norm").agg(F.count("*").alias("n")), "country_norm").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert ivf.compared(asked, pool, q).count() < pairs / 10
    if kind == "clusters":
        assert q.probes < len(q.centroids) / 3


def test_recall_on_the_given_vectors(spark):
    exact, near = (queries.QUERIES[n](spark, SF).select("s1_id", "cand_id") for n in ("dense_topk_exact", "dense_topk_ivf"))
    near = near.cache()
    assert exact.join(near, ["s1_id", "cand_id"], "left_semi").count() >= 0.95 * exact.count() > 0 and near.count() == exact.count()


def test_small_blocks_and_shuffled_sizes_give_the_same(spark, monkeypatch):
    x = drawn("clusters", 900, 7)
    x[300:600] = x[5]
    pool = frame(spark, x, ["a"] * 800 + ["b"] * 99 + [None]).cache()
    q = ivf.fit(pool, k=5)
    take = lambda: sorted(tuple(r) for r in ivf.top_k(pool.limit(200), pool, k=5, quantizer=q).collect())
    before = take()
    monkeypatch.setattr(ivf, "CELL", 50)
    monkeypatch.setattr(ivf, "ASKED", 30)
    monkeypatch.setattr(ivf, "BROADCAST_LISTS", -1)
    monkeypatch.setattr(blocks, "BROADCAST_GROUPS", -1)
    assert take() == before and len(before) > 900


def test_awkward_vectors(spark):
    rows = [("a", "x", [1.0, 0.0, 0.0]), ("b", "x", [0.9, 0.1]), ("c", "x", None), ("d", "x", [None, 1.0, 0.0]), ("e", None, [1.0, 0.0, 0.0]), ("f", "y", [0.0, 0.0, 0.0]), ("g", "y", [float("nan"), 0.0, 1.0]), ("h", "x", [])]
    pool = spark.createDataFrame(rows, "entity_id string, country_norm string, embedding array<float>").withColumns({c: F.lit("old") for c in ("list", "code", "u", "rank")})
    got = {(r.s1_id, r.cand_id) for r in ivf.top_k(pool, pool, k=2).collect()}
    assert ("a", "a") in got and ("a", "b") in got and not any("e" in p for p in got) and len([p for p in got if p[0] == "f"]) == 2
    assert ivf.top_k(pool.limit(0), pool, k=2).isEmpty() and ivf.top_k(pool, pool.limit(0), k=2).isEmpty()


def test_linkage_uses_it(spark, monkeypatch):
    pool = frame(spark, drawn("none", 60, 8), ["a"] * 60)
    s1 = pool.select("entity_id", "country_norm")
    config = Config(use_char=False, use_word=False, dense_top_k=3)
    got = linkage.strategies(s1, s1, config, (pool, pool))["dense"]
    assert got.count() == 180
    monkeypatch.setattr(linkage.ivf, "top_k", None)
    assert linkage.strategies(s1, s1, Config(use_char=False, use_word=False, dense_top_k=3, dense_exact=True), (pool, pool))["dense"].count() == 180

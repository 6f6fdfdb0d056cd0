"""Boosted trees against brute force, and what a search keeps."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from kinmesh.config import Config
from kinmesh.operators import boosting, training
from kinmesh.operators.boosting import Boosted, Settings
from kinmesh.sources import readers, writers


def rows_of(n, seed, d=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, d)), 2)
    x[:, 4] = rng.integers(0, 3, n)
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.7) | (x[:, 2] * x[:, 0] > 0.7) | (rng.random(n) < 0.03)).astype(int)
    return x, y, rng.random(n) < 0.25


def frame(spark, x, y, held):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("label", T.IntegerType()), T.StructField("validation", T.BooleanType())])
    return spark.createDataFrame([(i, Vectors.dense(v), int(label), bool(h)) for i, (v, label, h) in enumerate(zip(x, y, held, strict=True))], schema).repartition(3)


def brute_tree(x, g, h, s, depth=0):
    """The best split of every distinct value of every feature, by the formula; children below; pruned from the bottom."""
    worth = lambda a, b: max(abs(a) - s.alpha, 0) ** 2 / (b + s.lam)
    leaf = ("leaf", -s.step * np.sign(g.sum()) * max(abs(g.sum()) - s.alpha, 0) / (h.sum() + s.lam))
    best = (1e-6, None)
    if depth < s.depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= t
                if h[low].sum() >= s.least_hessian and h[~low].sum() >= s.least_hessian:
                    gain = worth(g[low].sum(), h[low].sum()) + worth(g[~low].sum(), h[~low].sum()) - worth(g.sum(), h.sum())
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, t))
    if best[1] is None:
        return leaf
    f, t = best[1]
    low = x[:, f] <= t
    sides = [brute_tree(x[m], g[m], h[m], s, depth + 1) for m in (low, ~low)]
    if best[0] < s.gamma and all(side[0] == "leaf" for side in sides):
        return leaf
    return ("split", f, t, *sides)


def follow(tree, v):
    while tree[0] == "split":
        tree = tree[3] if v[tree[1]] <= tree[2] else tree[4]
    return tree[1]


def test_trees_by_brute_force(spark):
    x, y, _ = rows_of(500, 1)
    held = np.zeros(len(x), bool)
    s = Settings(depth=3, step=0.3, trees=3, rows=1.0, columns=1.0, gamma=0.5)
    model = boosting.fit(frame(spark, x, y, held), s)
    assert len(model.trees) == 3
    w = np.where(y > 0, (len(y) - y.sum()) / y.sum(), 1.0)
    margin = np.zeros(len(x))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want = brute_tree(x, w * (p - y), w * p * (1 - p), s)
        values = np.array([follow(want, v) for v in x])
        assert np.allclose(tree.of_values(x), values, atol=1e-9)
        margin += values
    got = boosting.probabilities(frame(spark, x, y, held), [model]).select("id", "p").collect()
    assert np.allclose([r.p for r in sorted(got)], 1 / (1 + np.exp(-margin)))
    assert sum(model.importances) == pytest.approx(1) and max(model.importances) in model.importances[:3]


def test_penalties_hold():
    g, h = np.zeros((1, boosting.BINS)), np.zeros((1, boosting.BINS))
    g[0, :2], h[0, :2] = (-4, 4), (5, 5)
    one = np.array([0])
    plain = Settings(alpha=0.0, lam=1.0)
    assert boosting.best_split(g, h, one, plain)[:3] == (0, 0, pytest.approx(16 / 6 * 2))
    assert boosting.best_split(g, h, one, Settings(alpha=1.0, lam=3.0))[2] == pytest.approx(9 / 8 * 2)
    assert boosting.best_split(g, h, one, Settings(least_hessian=5.5))[0] == -1
    assert boosting.best_split(g, h, one, Settings(alpha=4.5))[0] == -1


def test_held_out_quality_early_stop_and_refresh(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 4)
    monkeypatch.setattr(boosting, "NODES", 2)
    x, y, held = rows_of(900, 2)
    pairs = frame(spark, x, y, held).cache()
    model = boosting.fit(pairs, Settings(depth=3, step=0.6, trees=14, patience=3, least_hessian=1.0))
    losses = model.losses
    assert len(model.trees) == int(np.argmin(losses)) + 1 and (len(losses) == 14 or len(losses) - len(model.trees) == 3)
    p = {r.id: r.p for r in boosting.probabilities(pairs, [model]).select("id", "p").collect()}
    loss = np.mean([-np.log(p[i] if y[i] else 1 - p[i]) for i in np.flatnonzero(held)])
    assert loss == pytest.approx(min(losses))
    ours = training.best_threshold(training.predict(pairs.filter("validation"), [model]))[1]
    theirs = training.best_threshold(training.predict(pairs.filter("validation"), [training.fit_gbt(pairs, depth=3, step=0.6, trees=14, seed=42)]))[1]
    assert ours >= theirs - 0.02 and ours > 0.85


def test_search_is_taken_up_again(spark, tmp_path, monkeypatch):
    x, y, held = rows_of(300, 3)
    pairs = frame(spark, x, y, held).cache()
    stages = writers.Stages(spark, f"file://{tmp_path}", "grid", Config())
    grid = ((2, 0.5, 2), (1, 0.1, 1))
    best, tried = training.grid_search(pairs, grid=grid, stages=stages)
    assert best == (2, 0.5, 2) and [t for t, _ in tried] == list(grid)

    def refuse(*a, **k):
        raise AssertionError("fitted again")

    monkeypatch.setattr(boosting, "fit", refuse)
    assert training.grid_search(pairs, grid=grid, stages=stages) == (best, tried)
    with pytest.raises(AssertionError):
        training.grid_search(pairs, grid=(*grid, (1, 0.2, 1)), stages=stages)


def test_models_are_saved_and_guarded(spark, tmp_path):
    x, y, held = rows_of(300, 4)
    pairs = frame(spark, x, y, held).cache()
    model = boosting.fit(pairs, Settings(depth=2, step=0.5, trees=2))
    writers.save_model(spark, [model, model], 0.4, ["a"], f"file://{tmp_path}/m")
    models, threshold = readers.load_model(spark, f"file://{tmp_path}/m", ["a"])
    assert threshold == 0.4 and [np.allclose(m.margins(x), model.margins(x)) for m in models] == [True, True]
    with pytest.raises(ValueError, match="other features"):
        readers.load_model(spark, f"file://{tmp_path}/m", ["b"])


def test_awkward_training_rows(spark):
    x, y, held = rows_of(40, 5)
    assert boosting.fit(frame(spark, x[:0], y[:0], held[:0]), Settings(trees=2)).trees == []
    one = boosting.fit(frame(spark, x, np.zeros(40, int), np.zeros(40, bool)), Settings(depth=2, trees=2))
    assert len(one.trees) == 2 and set(one.trees[0].feature) == {-1}
    x[::3, 0] = np.nan
    got = boosting.fit(frame(spark, x, y, held), Settings(depth=2, step=0.5, trees=2, least_hessian=0.5))
    assert np.isfinite(got.margins(x)).all() and Boosted([], 3).margins(x).tolist() == [0.0] * 40

"""Second-order boosted trees on histograms, with L1, L2 and split penalties.

Features are binned once and stored with a margin for each row. A level of a tree is one pass: every task sums gradients and hessians of
its rows by node, feature and bin; sums of a node meet in one place, where its best split is found, so that the driver sees one row for
each node. Sums of the children are known from the split, so leaves need no pass. Trees grown since margins were stored
are followed in the pass; margins are written anew every REFRESH trees, which also keeps plans short and lets lost executors read on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.sources.writers import stored

BINS, REFRESH = 128, 25
#: Nodes of one pass: a task holds 16 bytes for each of their features' bins.
NODES = 256
_NODE = "part long, node long, cell array<int>, g array<double>, h array<double>"
_SPLIT = "node long, feature int, cut int, gain double, gl double, hl double, gr double, hr double"
_ROW = "tree int, node int, feature int, threshold double, low int, high int, value double, gain double, n_features int, f double"


@dataclass(frozen=True)
class Settings:
    """Fixed values but depth, step and trees, which a grid varies."""

    depth: int = 8
    step: float = 0.05
    trees: int = 800
    rows: float = 0.8
    columns: float = 0.8
    least_hessian: float = 3.0
    gamma: float = 0.1
    alpha: float = 0.1
    lam: float = 1.0
    patience: int = 50


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1. Rows with at most threshold (bins up to cut) go to low, all others, NaN too, to high."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.low, -1), (self.high, -1), (self.value, 0.0), (self.gain, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def nodes(self, x: np.ndarray, limits: Sequence) -> np.ndarray:
        """Leaf of each row; limits are cuts for bins, thresholds for values."""
        feature, low, high, limit = (np.array(v) for v in (self.feature, self.low, self.high, limits))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= limit[here], low[here], high[here])
        return at

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins, self.cut)]

    def of_values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(x, self.threshold)]

    def prune(self, gamma: float) -> None:
        """Takes back splits of a gain below gamma whose children are leaves, from the bottom up."""
        for k in range(len(self.feature) - 1, -1, -1):
            if self.feature[k] >= 0 and self.feature[self.low[k]] < 0 and self.feature[self.high[k]] < 0 and self.gain[k] < gamma:
                self.feature[k] = -1


@dataclass
class Boosted:
    """Trees of one fit; losses: logarithmic loss on validation rows after each tree that was grown; f: F0.5 where a search has set it."""

    trees: list[Tree]
    n_features: int
    losses: list[float] = field(default_factory=list)
    f: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        return sum((t.of_values(x) for t in self.trees), np.zeros(len(x)))

    @property
    def importances(self) -> list[float]:
        """Mean gain of each feature's splits, as shares of their sum."""
        total, n = np.zeros(self.n_features), np.zeros(self.n_features)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += gain
                    n[f] += 1
        mean = total / np.maximum(n, 1)
        return (mean / mean.sum() if mean.sum() else mean).tolist()

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each node, to be stored; from_frame reads it."""
        rows = [(i, k, t.feature[k], t.threshold[k], t.low[k], t.high[k], t.value[k], t.gain[k], self.n_features, self.f) for i, t in enumerate(self.trees) for k in range(len(t.feature))]
        return spark.createDataFrame(rows or [(-1, 0, -1, 0.0, -1, -1, 0.0, 0.0, self.n_features, self.f)], _ROW)

    @classmethod
    def from_frame(cls, df: DataFrame) -> Boosted:
        trees: dict[int, Tree] = {}
        rows = df.orderBy("tree", "node").collect()
        for r in rows:
            if r["tree"] >= 0:
                t = trees.setdefault(r["tree"], Tree())
                k = t.add()
                t.feature[k], t.threshold[k], t.low[k], t.high[k], t.value[k], t.gain[k] = r["feature"], r["threshold"], r["low"], r["high"], r["value"], r["gain"]
        return cls(list(trees.values()), rows[0]["n_features"], f=rows[0]["f"])


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _worth(g, h, s: Settings):
    return shrunk(g, s.alpha) ** 2 / (h + s.lam)


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Settings) -> tuple[int, int, float, float, float, float, float]:
    """(feature, cut, gain, then sums of both sides) of a node's sums (features x bins); feature -1 and all sums on one side where no split gains."""
    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    total_g, total_h = float(g[columns[0]].sum()), float(h[columns[0]].sum())
    gr, hr = total_g - gl, total_h - hl
    allowed = np.zeros(g.shape[0], bool)
    allowed[columns] = True
    good = (hl >= s.least_hessian) & (hr >= s.least_hessian) & allowed[:, None]
    gain = np.where(good, _worth(gl, hl, s) + _worth(gr, hr, s) - _worth(total_g, total_h, s), -np.inf)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, cut] > 1e-6:
        return -1, 0, 0.0, total_g, total_h, 0.0, 0.0
    return int(f), int(cut), float(gain[f, cut]), float(gl[f, cut]), float(hl[f, cut]), float(gr[f, cut]), float(hr[f, cut])


def edges_of(pairs: DataFrame, n_features: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper limits of each feature's bins but the last, by quantiles over all training rows, in one aggregate."""
    share = [i / bins for i in range(1, bins)]
    x = pairs.filter("NOT validation").select(vector_to_array("features").alias("x"))
    value = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    row = x.agg(*(F.percentile_approx(value(i), share, 10_000).alias(f"q{i}") for i in range(n_features))).first()
    return [np.unique(np.array(row[f"q{i}"] or [], np.float64)) for i in range(n_features)]


def _matrix(column: pa.Array, n_features: int, kind) -> np.ndarray:
    if pa.types.is_list(column.type):
        return np.asarray(column.flatten(), kind).reshape(len(column), n_features)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), n_features)


def _binned(pairs: DataFrame, edges: list[np.ndarray], heavy: float) -> DataFrame:
    """label, w, validation, key (the same for every run), bins (a byte a feature), margin 0; stored."""
    d = len(edges)
    others = sorted(c for c in pairs.columns if c not in ("features", "label", "validation"))
    rows = pairs.select(F.col("label").cast("double").alias("label"), F.coalesce(F.col("validation"), F.lit(False)).alias("validation"), F.xxhash64(vector_to_array("features"), *others).alias("key"), vector_to_array("features").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d, np.float64)
            bins = np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8) if len(x) else np.empty((0, d), np.uint8)
            label = batch.column("label").to_numpy()
            columns = [pa.array(label), pa.array(np.where(label > 0, heavy, 1.0)), batch.column("validation"), batch.column("key"), pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(np.zeros(len(x)))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "w", "validation", "key", "bins", "margin"])

    return stored(rows.mapInArrow(run, "label double, w double, validation boolean, key long, bins binary, margin double"), "binned")


def _drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    x = key.view(np.uint64) ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1.0) * (2**64 - 2048))


def _margins(batch: pa.RecordBatch, trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    out = batch.column("margin").to_numpy().copy()
    for t in trees:
        out += t.of_bins(bins)
    return out


def _level(rows: DataFrame, d: int, recent: list[Tree], tree: Tree, active: list[int], columns: np.ndarray, draw: int, s: Settings) -> dict[int, tuple]:
    """Best split of each active node of tree. With the root among them, node -1 has the loss and number of validation rows as gl and hl."""
    place = {k: i for i, k in enumerate(active)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g, h, loss, n = np.zeros(len(active) * d * BINS), np.zeros(len(active) * d * BINS), 0.0, 0
        number = np.full(len(tree.feature), -1)
        number[active] = np.arange(len(active))
        for batch in batches:
            bins = _matrix(batch.column("bins"), d, np.uint8)
            margin, label = _margins(batch, recent, bins), batch.column("label").to_numpy()
            held = batch.column("validation").to_numpy(zero_copy_only=False).astype(bool)
            if 0 in place:
                m, y = margin[held], label[held]
                loss += float(np.logaddexp(0, np.where(y > 0, -m, m)).sum())
                n += int(held.sum())
            node = number[tree.nodes(bins, tree.cut)]
            used = np.flatnonzero(~held & (node >= 0) & _drawn(batch.column("key").to_numpy(), draw, s.rows))
            w, p = batch.column("w").to_numpy()[used], 1 / (1 + np.exp(-margin[used]))
            cell = (node[used, None] * (d * BINS) + np.arange(d)[None, :] * BINS + bins[used]).ravel()
            g += np.bincount(cell, np.repeat(w * (p - label[used]), d), len(g))
            h += np.bincount(cell, np.repeat(w * np.maximum(p * (1 - p), 1e-16), d), len(h))
        part, out = TaskContext.get().partitionId(), [(-1, [0], [loss], [float(n)])] if 0 in place else []
        for k, i in place.items():
            mine = slice(i * d * BINS, (i + 1) * d * BINS)
            some = np.flatnonzero(h[mine])
            if len(some):
                out.append((k, some.astype(np.int32), g[mine][some], h[mine][some]))
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int64()), *(pa.array([o[c] for o in out], kinds[c]) for c in range(4))], ["part", "node", "cell", "g", "h"])

    def split(group: pa.Table) -> pa.Table:
        node, g, h = group.column("node")[0].as_py(), np.zeros(d * BINS), np.zeros(d * BINS)
        # In order of parts: sums, and so splits, are the same whenever the rows lie the same.
        for i in np.argsort(group.column("part").to_numpy(), kind="stable").tolist():
            cell = np.asarray(group.column("cell")[i].values)
            g[cell] += np.asarray(group.column("g")[i].values)
            h[cell] += np.asarray(group.column("h")[i].values)
        best = (-1, 0, 0.0, g[0], h[0], 0.0, 0.0) if node < 0 else best_split(g.reshape(d, BINS), h.reshape(d, BINS), columns, s)
        return pa.table({"node": [node], "feature": pa.array([best[0]], pa.int32()), "cut": pa.array([best[1]], pa.int32())} | {n: [float(v)] for n, v in zip(("gain", "gl", "hl", "gr", "hr"), best[2:], strict=True)})

    found = rows.select("label", "w", "validation", "key", "bins", "margin").mapInArrow(sums, _NODE).groupBy("node").applyInArrow(split, _SPLIT)
    return {r["node"]: tuple(r)[1:] for r in found.collect()}


def _grow(rows: DataFrame, edges: list[np.ndarray], recent: list[Tree], number: int, seed: int, s: Settings) -> tuple[Tree, tuple[float, float]]:
    """(tree, (loss, number) of validation rows before it)."""
    d, tree = len(edges), Tree()
    draw = np.random.default_rng([seed, number])
    columns = np.sort(draw.choice(d, max(1, round(s.columns * d)), replace=False))
    sums, level, held = {tree.add(): None}, [0], (0.0, 0.0)
    for depth in range(max(1, s.depth)):
        if not level:
            break
        found: dict[int, tuple] = {}
        for a in range(0, len(level), NODES):
            found |= _level(rows, d, recent, tree, level[a : a + NODES], columns, seed * 100_003 + number, s)
        if not depth:
            _, _, _, loss, n, _, _ = found.pop(-1, (0, 0, 0, 0.0, 0.0, 0, 0))
            held = (loss, n)
        following = []
        for k in level:
            feature, cut, gain, gl, hl, gr, hr = found.get(k, (-1, 0, 0.0, 0.0, 0.0, 0.0, 0.0))
            if sums[k] is None:
                sums[k] = (gl + gr, hl + hr)
            if feature < 0 or not s.depth:
                continue
            tree.feature[k], tree.cut[k], tree.threshold[k], tree.gain[k] = feature, cut, float(edges[feature][cut]), gain
            tree.low[k], tree.high[k] = tree.add(), tree.add()
            sums[tree.low[k]], sums[tree.high[k]] = (gl, hl), (gr, hr)
            following += [tree.low[k], tree.high[k]]
        level = following
    for k, (g, h) in sums.items():
        tree.value[k] = float(-s.step * shrunk(g, s.alpha) / (h + s.lam)) if h else 0.0
    tree.prune(s.gamma)
    return tree, held


def _moved(rows: DataFrame, d: int, trees: list[Tree]) -> DataFrame:
    """rows with the trees' values in their margins; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margins(batch, trees, _matrix(batch.column("bins"), d, np.uint8))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "w", "validation", "key", "bins")), pa.array(margin)], ["label", "w", "validation", "key", "bins", "margin"])

    return stored(rows.mapInArrow(run, rows.schema), "margins")


def fit(pairs: DataFrame, settings: Settings, *, seed: int = 42) -> Boosted:
    """pairs: features (vector), label, validation; other columns only tell rows apart. True pairs weigh as much as all others together.

    Without validation rows all trees are kept; with them those up to the least loss, growing ends patience trees after it. Null
    validation is none. Without training rows there are no trees, and every probability is a half. NaN lies above every value.
    """
    counts = pairs.filter("NOT coalesce(validation, false)").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array("features"))).alias("d")).first()
    if not counts["n"]:
        return Boosted([], 0)
    pairs = pairs.withColumn("validation", F.coalesce("validation", F.lit(False)))
    edges = edges_of(pairs, counts["d"])
    rows = _binned(pairs, edges, (counts["n"] - counts["p"]) / max(counts["p"], 1) or 1.0)
    trees, recent, losses = [], [], []
    for number in range(settings.trees + 1):
        if len(recent) == REFRESH:
            rows, recent = _moved(rows, len(edges), recent), []
        # The last pass is for the loss alone.
        last = number == settings.trees
        tree, (loss, n) = _grow(rows, edges, recent, number, seed, replace(settings, depth=0) if last else settings)
        if number and n:
            losses.append(loss / n)
            if len(losses) - 1 - int(np.argmin(losses)) >= settings.patience:
                break
        if last:
            break
        trees.append(tree)
        recent.append(tree)
    kept = int(np.argmin(losses)) + 1 if losses else len(trees)
    return Boosted(trees[:kept], len(edges), losses)


def probabilities(rows: DataFrame, models: Sequence[Boosted], out: str = "p") -> DataFrame:
    """rows (features) plus the mean of the models' probabilities, from one pass of Arrow batches."""
    shared = rows.sparkSession.sparkContext.broadcast(list(models))

    @F.pandas_udf("double")
    def p(x):
        import pandas as pd

        m = np.stack(x.to_list()) if len(x) else np.empty((0, 1))
        return pd.Series(sum(1 / (1 + np.exp(-b.margins(m))) for b in shared.value) / max(1, len(shared.value)))

    return rows.withColumn(out, p(vector_to_array("features")))


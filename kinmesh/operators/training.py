"""Training pairs, boosted trees, ensembles, hard negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.config import Config
from kinmesh.operators import boosting
from kinmesh.operators.boosting import Boosted, Settings
from kinmesh.operators.decide import pr_curve
from kinmesh.operators.order import smallest
from kinmesh.sources.samples import shuffled
from kinmesh.sources.writers import Stages, stored

Model = Boosted | GBTClassificationModel

# Fixed values: (depth, step, trees) of the settings that are tried.
GRID = ((8, 0.05, 800), (10, 0.05, 800), (10, 0.03, 1200), (12, 0.05, 600), (8, 0.1, 500), (10, 0.1, 500))
# The first generation's single setting.
SINGLE_V1 = Settings(8, 0.1, 500, least_hessian=5.0, patience=30)


def split_entities(entities: DataFrame, config: Config) -> DataFrame:
    """(s1_id, validation): a tenth of the entities, ten at least, in seeded order."""
    ids = entities.select("s1_id").distinct()
    n = ids.count()
    held = max(int(n * config.val_fraction), config.val_least)
    chosen = ids.orderBy(shuffled("s1_id", config.seed), "s1_id").limit(held).withColumn("validation", F.lit(True))
    return ids.join(chosen, "s1_id", "left").withColumn("validation", F.coalesce("validation", F.lit(False)))


def labelled_pairs(candidates: DataFrame, truth: DataFrame, *, ratio: int | None = None, seed: int = 42, least: int = 2) -> DataFrame:
    """(s1_id, cand_id, label). All true candidates; of the others all, or for each entity ratio times its true ones, `least` at least."""
    pairs = candidates.select("s1_id", "cand_id").distinct().join(truth.select("s1_id", "cand_id", F.lit(1).alias("label")).distinct(), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    if ratio is None:
        return pairs
    by = Window.partitionBy("s1_id")
    place = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(F.md5(F.concat_ws("|", "s1_id", "cand_id", F.lit(str(seed)))), "cand_id"))
    numbered = pairs.withColumns({"_pos": F.sum("label").over(by), "_n": place})
    return numbered.filter((F.col("label") == 1) | (F.col("_n") <= F.greatest(F.col("_pos") * ratio, F.lit(least)))).drop("_pos", "_n")


def labelled_scores(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """scores (s1_id, cand_id, p), each pair once, plus label: nothing is scored again to be labelled."""
    known = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1)).hint("shuffle_hash")
    return scores.join(known, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def labelled_pairs_v1(candidates: DataFrame, truth: DataFrame, seed: int = 42) -> DataFrame:
    """First generation: three others for each true candidate, two where there is none."""
    return labelled_pairs(candidates, truth, ratio=3, seed=seed, least=2)


def assembled(features: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep").transform(features)


def fit_single_v1(pairs: DataFrame, seed: int = 42, settings: Settings | None = None) -> Boosted:
    """First generation: one model of one setting."""
    return boosting.fit(pairs, settings or SINGLE_V1, seed=seed)


def fit_gbt(pairs: DataFrame, *, depth: int, step: float, trees: int, seed: int) -> GBTClassificationModel:
    """Spark's own trees, without L1, L2 and split penalties. pairs: features (vector), label, validation. True pairs weigh as much as all others together; stops early on validation rows."""
    counts = pairs.filter("NOT validation").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    heavy = (counts["n"] - counts["p"]) / max(1, counts["p"] or 0)
    weighted = pairs.withColumns({"w": F.when(F.col("label") == 1, float(max(heavy, 1e-6))).otherwise(1.0), "label": F.col("label").cast("double")})
    return GBTClassifier(maxDepth=depth, stepSize=step, maxIter=trees, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, weightCol="w", validationIndicatorCol="validation", validationTol=0.001).fit(weighted)


def predict(rows: DataFrame, models: Sequence[Model]) -> DataFrame:
    """rows plus p: the mean of the models' probabilities."""
    if all(isinstance(m, Boosted) for m in models):
        return boosting.probabilities(rows, models)
    for i, m in enumerate(models):
        m = m.copy().setPredictionCol(f"_y{i}").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
        rows = m.transform(rows).withColumn(f"_q{i}", vector_to_array(F.col(f"_p{i}"))[1]).drop(f"_y{i}", f"_p{i}", f"_r{i}")
    total = sum((F.col(f"_q{i}") for i in range(1, len(models))), F.col("_q0"))
    return rows.withColumn("p", total / len(models)).drop(*(f"_q{i}" for i in range(len(models))))


def best_threshold(labelled: DataFrame, *, lowest: bool = False) -> tuple[float, float]:
    """(threshold, F0.5) of single pairs; of equal ones the higher threshold, or the lowest, as the first generation takes it."""
    row = pr_curve(labelled).orderBy(F.desc("f"), F.asc("threshold") if lowest else F.desc("threshold")).first()
    return (row["threshold"], row["f"]) if row else (0.5, 0.0)


def grid_search(pairs: DataFrame, *, grid: Sequence[tuple[int, float, int]] = GRID, seed: int = 42, stages: Stages | None = None) -> tuple[tuple[int, float, int], list[tuple[tuple[int, float, int], float]]]:
    """The setting with the best pair F0.5 on validation rows, and all settings with theirs. With stages each setting's model is kept, and a later run fits the others only."""
    spark, tried = pairs.sparkSession, []
    for depth, step, trees in grid:

        def fitted(s: Settings = Settings(depth, step, trees)) -> DataFrame:
            model = boosting.fit(pairs, s, seed=seed)
            model.f = best_threshold(predict(pairs.filter("validation"), [model]))[1]
            return model.frame(spark)

        made = stages.stage(f"grid-{depth}-{step}-{trees}", fitted) if stages else fitted()
        tried.append(((depth, step, trees), Boosted.from_frame(made).f))
    return max(tried, key=lambda x: x[1])[0], tried


def ensemble(pairs: DataFrame, setting: tuple[int, float, int], config: Config) -> list[Boosted]:
    """n_models fits that differ in their seed."""
    return [boosting.fit(pairs, Settings(*setting), seed=config.seed + i) for i in range(config.n_models)]


def importance(models: Sequence[Model], names: Sequence[str], top: int = 15) -> list[tuple[str, float]]:
    shares = [m.importances if isinstance(m, Boosted) else [float(v) for v in m.featureImportances.toArray()] for m in models]
    total = [sum(s[i] for s in shares if i < len(s)) / len(models) for i in range(len(names))]
    return sorted(zip(names, total, strict=True), key=lambda x: (-x[1], x[0]))[:top]


def mine_hard_negatives(scored: DataFrame, config: Config) -> DataFrame:
    """scored: s1_id, cand_id, label, p. All true pairs; at most hard_ratio others for each, hard_mix of them false ones scored high, the rest any.

    Samples are those first by seeded digest. Pairs are scored once and stored: numbers are counted first, then ranges of the digest, so that no row is sorted or leaves the executors.
    """
    scored = stored(scored, "scored")
    counts = scored.agg(F.sum("label").alias("p"), F.sum(F.when((F.col("label") == 0) & (F.col("p") >= config.hard_floor), 1).otherwise(0)).alias("h"), F.count(F.lit(1)).alias("n")).first()
    positives, hard, others = counts["p"] or 0, counts["h"] or 0, (counts["n"] or 0) - (counts["p"] or 0)
    wanted = min(config.hard_ratio * positives, others)
    n_hard = min(int(wanted * config.hard_mix), hard)
    place = F.md5(F.concat_ws("|", "s1_id", "cand_id", F.lit(str(config.seed))))
    negatives = scored.filter("label = 0").withColumn("_o", place)
    tough = smallest(negatives.filter(F.col("p") >= config.hard_floor), "_o", ["s1_id", "cand_id"], n_hard)
    rest = smallest(negatives.join(tough.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti"), "_o", ["s1_id", "cand_id"], max(0, wanted - n_hard))
    return scored.filter("label = 1").unionByName(tough.drop("_o")).unionByName(rest.drop("_o"))

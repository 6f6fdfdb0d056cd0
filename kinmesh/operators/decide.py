"""From scored pairs (s1_id, cand_id, p) to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.operators.order import running

#: Thresholds that tuning tries: .05 to .94 in steps of .01, .95 to .995 in steps of .005. Fixed values.
GRID = tuple(i / 1000 for i in (*range(50, 950, 10), *range(950, 1000, 5)))


def with_evidence(scores: DataFrame) -> DataFrame:
    """scores plus best (of the entity, over all its pairs) and owner (whether the pair is its candidate's best; ties to the smaller entity).

    Neither depends on the threshold, so any number of thresholds can be tried on one result.
    """
    owner = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("p"), "s1_id")) == 1
    return scores.withColumns({"best": F.max("p").over(Window.partitionBy("s1_id")), "owner": owner})


def decide(scores: DataFrame, threshold: float, *, one_to_one: bool = True, singleton_best: float | None = 0.4) -> DataFrame:
    """Matches (s1_id, cand_id, p): p reaches the threshold, each candidate goes to one entity, entities whose best pair is poor have none."""
    out = with_evidence(scores).filter(F.col("p") >= threshold)
    if one_to_one:
        out = out.filter("owner")
    if singleton_best is not None:
        out = out.filter(F.col("best") >= singleton_best)
    return out.select("s1_id", "cand_id", "p")


def decide_v1(scores: DataFrame, threshold: float) -> DataFrame:
    """First generation: the threshold alone."""
    return scores.filter(F.col("p") >= threshold).select("s1_id", "cand_id", "p")


def grouped(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(s1_id, cands): every entity with its sorted candidates, an empty array for none."""
    lists = matches.groupBy("s1_id").agg(F.sort_array(F.collect_set("cand_id")).alias("cands"))
    return entities.select("s1_id").distinct().join(lists, "s1_id", "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<string>")))


def tune(scores: DataFrame, truth: DataFrame, entities: DataFrame, *, one_to_one: bool = True, singleton_best: float = 0.4) -> DataFrame:
    """(threshold, score): macro F0.5 of the decision at each threshold of GRID; the best is first, ties nearest to 0.5 first.

    Pairs are scored and owned once. Below a threshold an entity predicts nothing, so only its surviving pairs are expanded.
    """
    spark = scores.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in GRID))).alias("threshold"))
    known = scores.join(truth.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    sure = with_evidence(known).filter(F.col("best") >= singleton_best)
    if one_to_one:
        sure = sure.filter("owner")
    taken = sure.filter(F.col("p") >= GRID[0]).withColumn("threshold", F.explode(F.filter(F.array(*(F.lit(t) for t in GRID)), lambda t: t <= F.col("p"))))
    predicted = taken.groupBy("threshold", "s1_id").agg(F.count(F.lit(1)).alias("np"), F.sum("hit").alias("tp"))
    sizes = entities.select("s1_id").distinct().join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("nt")), "s1_id", "left").withColumn("nt", F.coalesce("nt", F.lit(0)))
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("nt") == 0, 1).otherwise(0)).alias("empty"))
    # An entity without predictions scores 1 if it has no matches and 0 if it has, at every threshold.
    made = predicted.join(sizes, "s1_id").groupBy("threshold").agg(F.sum(F.when((F.col("nt") > 0) & (F.col("tp") > 0), 1.25 * F.col("tp") / (F.col("np") + 0.25 * F.col("nt"))).otherwise(0.0)).alias("f"), F.sum(F.when(F.col("nt") == 0, 1).otherwise(0)).alias("wrong"))
    out = grid.join(F.broadcast(made), "threshold", "left").join(F.broadcast(totals))
    score = F.round((F.coalesce("f", F.lit(0.0)) + F.col("empty") - F.coalesce("wrong", F.lit(0))) / F.col("n"), 6)
    return out.select("threshold", score.alias("score")).orderBy(F.desc("score"), F.abs(F.col("threshold") - 0.5), "threshold")


def pr_curve(labelled: DataFrame, beta: float = 0.5) -> DataFrame:
    """(threshold, precision, recall, f) at every distinct score of (p, label), pairs counted alone. Scores are dealt by ranges; no task sees them all."""
    by = labelled.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.sum("label").cast("bigint").alias("hit"))
    run, total = running(by, [F.desc("p")], {"n": "c", "tp": "hit"})
    run = run.withColumn("threshold", F.col("p"))
    precision, recall = F.col("tp") / F.col("n"), F.col("tp") / F.lit(total["tp"]) if total["tp"] else F.lit(0.0)
    run = run.withColumns({"precision": precision, "recall": recall})
    b = beta * beta
    f = F.when(F.col("tp") > 0, (1 + b) * F.col("precision") * F.col("recall") / (b * F.col("precision") + F.col("recall"))).otherwise(0.0)
    return run.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f, 6).alias("f"))

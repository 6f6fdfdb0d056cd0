"""Whole runs: train, predict, both, and evaluation of blocking."""

from __future__ import annotations

import hashlib
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.config import Config
from kinmesh.operators import blocking, decide, evaluate, features, ivf, neighbours, tfidf, training
from kinmesh.sources import readers, samples, writers
from kinmesh.sources.writers import Stages

#: Two small settings for a first look; training tries training.GRID unless told otherwise.
QUICK_GRID = ((8, 0.1, 60), (10, 0.1, 60))


@dataclass
class Trained:
    models: list
    threshold: float
    score: float
    importance: list[tuple[str, float]]
    losses: DataFrame


class Timings:
    """Seconds of each strategy, measured as it runs: build is what happens before its rows are asked for (an index, say), query is the making of its
    rows, which are stored and used by everything that follows. No job is run for the sake of a figure."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, float]] = []

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.monotonic()
        df = make().select("s1_id", "cand_id")
        built = time.monotonic()
        df = writers.stored(df, name)
        self.rows.append((name, built - began, time.monotonic() - built))
        return df

    def frame(self, spark: SparkSession, n_queries: int) -> DataFrame:
        """(strategy, build_seconds, ms_per_query), UNION being the sum of all."""
        rows = [*self.rows, ("UNION", sum(r[1] for r in self.rows), sum(r[2] for r in self.rows))]
        return spark.createDataFrame([(n, round(b, 3), round(1000 * q / max(1, n_queries), 3)) for n, b, q in rows], "strategy string, build_seconds double, ms_per_query double")


def strategies(s1: DataFrame, pool: DataFrame, config: Config, vectors: tuple[DataFrame, DataFrame] | None = None, timed: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Candidates of every strategy that the settings turn on, in a fixed order.

    timed: a Timings, or anything else that makes a strategy's rows.

    vectors: (queries, pool) with entity_id, country_norm, embedding from any encoder; without them dense retrieval is off, with a warning.
    """
    if config.use_dense and vectors is None:
        warnings.warn("dense retrieval is on, but there are no vectors: it is left out", stacklevel=2)
    run, out = timed or (lambda name, make: make()), {}
    if config.use_char:
        out["char_tfidf"] = run("char_tfidf", lambda: tfidf.retrieve(s1, pool, "char", k=config.char_top_k, max_df=config.max_df, max_features=config.char_max_features))
    if config.use_keys:
        out |= {name: run(name, lambda df=df: df) for name, df in blocking.block_keys(s1, pool, config.key_bucket).items()}
    if config.use_word:
        out["word_tfidf"] = run("word_tfidf", lambda: tfidf.retrieve(s1, pool, "word", k=config.word_top_k, max_features=config.word_max_features))
    if config.name_top_k:
        out["name_tfidf"] = run("name_tfidf", lambda: tfidf.retrieve(s1, pool, "name", k=config.name_top_k, max_df=config.max_df, max_features=config.name_max_features))
    if config.use_dense and vectors is not None:
        out["dense"] = run("dense", lambda: (neighbours.dense_top_k if config.dense_exact else ivf.top_k)(*vectors, k=config.dense_top_k))
    if config.use_lsh:
        out["lsh"] = run("lsh", lambda: neighbours.lsh_pairs(s1, pool, permutations=config.lsh_permutations, threshold=config.lsh_threshold, cap=config.lsh_cap, ngram=config.lsh_ngram))
    return {name: df.select("s1_id", "cand_id") for name, df in out.items()}


def candidates(s1: DataFrame, pool: DataFrame, config: Config, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Union of the strategies, crowded entities cut back to the best."""
    return blocking.prefilter(blocking.union(strategies(s1, pool, config, vectors)), s1, pool, cap=config.prefilter_cap, min_score=config.prefilter_min_score)


def records_of(stages: Stages, s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides from the shared folder: every strategy reads normalised records instead of making them."""
    return stages.stage("s1", lambda: s1), stages.stage("pool", lambda: pool)


def score(pairs: DataFrame, s1: DataFrame, pool: DataFrame, models: list, floor: float | None = None) -> DataFrame:
    """(s1_id, cand_id, p); pairs below the floor aren't kept."""
    rows = training.assembled(features.pair_features(blocking.pair_texts(pairs, s1, pool)), features.FEATURE_NAMES)
    out = training.predict(rows, models).select("s1_id", "cand_id", F.col("p").cast("float").alias("p"))
    return out if floor is None else out.filter(F.col("p") >= floor)


def run_train(s1: DataFrame, pool: DataFrame, truth: DataFrame, config: Config, stages: Stages, *, grid=training.GRID, vectors=None) -> Trained:
    """Blocks, labels, fits the grid and an ensemble of the best setting, tunes the threshold on held-out entities.

    With neg_pos_ratio set, a second round adds hard negatives. Every stage is stored and taken up again by a later run.
    """
    s1, pool = records_of(stages, s1, pool)
    entities = s1.select(F.col("entity_id").alias("s1_id"))
    split = stages.stage("split", lambda: training.split_entities(entities, config))
    pairs = stages.stage("candidates", lambda: candidates(s1, pool, config, vectors))

    def vectors_of(labelled: DataFrame) -> DataFrame:
        rows = features.pair_features(blocking.pair_texts(labelled, s1, pool))
        return training.assembled(rows.join(labelled, ["s1_id", "cand_id"]).join(split, "s1_id"), features.FEATURE_NAMES).select("s1_id", "cand_id", "label", "validation", "features")

    labelled = stages.stage("pairs", lambda: vectors_of(training.labelled_pairs(pairs, truth, ratio=config.neg_pos_ratio, seed=config.seed)))
    setting, _ = training.grid_search(labelled, grid=grid, seed=config.seed, stages=stages)
    models = training.ensemble(labelled, setting, config)
    if config.neg_pos_ratio is not None:
        everything = vectors_of(training.labelled_pairs(pairs, truth))
        mined = training.mine_hard_negatives(training.predict(everything.filter("NOT validation"), models), config).select("s1_id", "cand_id", "label", "validation", "features")
        models = training.ensemble(mined.unionByName(labelled.filter("validation")), setting, config)
    held = split.filter("validation").select("s1_id")
    scores = stages.stage("scores", lambda: score(pairs.join(held, "s1_id", "left_semi"), s1, pool, models))
    known = truth.join(held, "s1_id", "left_semi")
    best = decide.tune(scores, known, held, one_to_one=config.one_to_one, singleton_best=config.singleton_best).first()
    matches = decide.decide(scores, best["threshold"], one_to_one=config.one_to_one, singleton_best=config.singleton_best)
    return Trained(models, best["threshold"], best["score"], training.importance(models, features.FEATURE_NAMES), evaluate.loss_breakdown(held, known, matches))


def run_predict(s1: DataFrame, pool: DataFrame, models: list, threshold: float, config: Config, stages: Stages, vectors=None) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates). Countries never meet in a join, so one run does what a loop over them would."""
    config.check_floor(threshold)
    s1, pool = records_of(stages, s1, pool)
    pairs = stages.stage("candidates", lambda: candidates(s1, pool, config, vectors))
    scores = stages.stage("scores", lambda: score(pairs, s1, pool, models, config.score_floor))
    return decide.decide(scores, threshold, one_to_one=config.one_to_one, singleton_best=config.singleton_best), pairs


def load_training(spark: SparkSession, paths: dict[str, str], config: Config, sample_size: int | None, *, generation: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s1, pool, truth) of a training folder: a sample of the first source, its matches, and pool records of its countries (generation 1: of a sample's, a quota each)."""
    from kinmesh.config import pool_extra

    raw = readers.read_tsv(spark, paths["truth"], readers.TRUTH_SCHEMA)
    known = readers.truth_entities(raw).withColumnRenamed("s1_id", "entity_id")
    how = {"transliterate": config.transliterate, "generation": generation}
    s1 = readers.load_source(spark, paths["s1"], **how).join(known, "entity_id", "left_semi")
    if sample_size:
        s1 = samples.sample_ids(s1, sample_size, config.seed)
    truth = readers.parse_truth(raw).join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    pool = samples.restrict_to_countries(readers.union_pool(*readers.load_sources(spark, paths["s2"], paths["s3"], **how)), s1)
    must = truth.select(F.col("cand_id").alias("entity_id"))
    if generation == 1 and sample_size:
        return s1, samples.quota_pool_v1(pool, must, sample_size, config.seed), truth
    extra = pool_extra(sample_size, sample_size is None, config.pool_extra) if generation == 2 else None
    return s1, samples.sample_pool(pool, must, extra, config.seed), truth


def evaluate_blocking(spark: SparkSession, paths: dict[str, str], country: str, config: Config, *, n_queries: int, pool_fraction: float, vectors=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, unique recall, cap curve) of one country, on sampled queries and a sampled pool that holds all their matches. The report has each strategy's build_seconds and
    ms_per_query, taken while its candidates were made; FINAL, which is cut from them, has none."""
    raw = readers.read_tsv(spark, paths["truth"], readers.TRUTH_SCHEMA)
    load = lambda source: readers.load_country(spark, paths[source], country, transliterate=config.transliterate)
    s1 = samples.sample_ids(load("s1"), n_queries, config.seed)
    entities = s1.select(F.col("entity_id").alias("s1_id"))
    truth = readers.parse_truth(raw).join(entities, "s1_id", "left_semi")
    pool = readers.union_pool(load("s2"), load("s3"))
    pool = samples.bernoulli_pool(pool, truth.select(F.col("cand_id").alias("entity_id")), pool_fraction, config.seed)
    s1, pool, timings = writers.stored(s1, "s1"), writers.stored(pool, "pool"), Timings()
    found = strategies(s1, pool, config, vectors, timings)
    everything = blocking.union(found)
    final = blocking.prefilter(everything, s1, pool, cap=config.prefilter_cap, min_score=config.prefilter_min_score)
    seconds = timings.frame(spark, s1.count())
    return evaluate.blocking_report(entities, truth, found, final).join(F.broadcast(seconds), "strategy", "left"), evaluate.unique_recall(truth, blocking.tagged(found)), evaluate.cap_curve(truth, blocking.ranked_candidates(everything, s1, pool))


def encoded(records: DataFrame, encode: Callable[[DataFrame], DataFrame], root: str, *, encoder: str) -> DataFrame:
    """entity_id, country_norm, embedding of records from any encoder: a function of a frame with entity_id and combined that gives entity_id and embedding.

    The store below root is by text: what is missing in it is encoded, each distinct text once, and appended as a segment; all else is read. encoder names the
    model and its settings, and has a store of its own. A null text counts as the empty one. Texts that the encoder gives nothing for are asked again next time and have no row.
    """
    spark, text = records.sparkSession, F.coalesce("combined", F.lit(""))
    path = f"{root}/embeddings-{hashlib.sha256(encoder.encode()).hexdigest()[:16]}"
    rows = records.select("entity_id", "country_norm", text.alias("combined"), F.sha2(text, 256).alias("_text"))
    missing = rows.groupBy("_text").agg(F.first("combined").alias("combined"))
    segments = writers.segments(spark, path)
    if segments:
        missing = missing.join(spark.read.parquet(*segments).select("_text"), "_text", "left_anti")
    missing = writers.stored(missing, "missing")
    if not missing.isEmpty():
        made = encode(missing.select(F.col("_text").alias("entity_id"), "combined"))
        made.select(F.col("entity_id").alias("_text"), F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(f"{path}/segment-{uuid.uuid4().hex}")
    segments = writers.segments(spark, path)
    known = spark.read.parquet(*segments).dropDuplicates(["_text"]) if segments else spark.createDataFrame([], "_text string, embedding array<float>")
    return rows.join(known, "_text").select("entity_id", "country_norm", "embedding")


def run_full(train: tuple[DataFrame, DataFrame, DataFrame], test: tuple[DataFrame, DataFrame], config: Config, stages: Callable[[str], Stages], **how) -> tuple[Trained, DataFrame, DataFrame]:
    """Trains on (s1, pool, truth) and predicts (s1, pool): the model, matches and candidates. stages: the stages of a kind of run."""
    trained = run_train(*train, config, stages("train"), **how)
    return trained, *run_predict(*test, trained.models, trained.threshold, config, stages("predict"))


def write_run(entities: DataFrame, matches: DataFrame, pairs: DataFrame, out_dir: str, *, single_file: bool = True) -> None:
    writers.write_results(entities.select(F.col("entity_id").alias("s1_id")), matches, pairs, out_dir, single_file=single_file)

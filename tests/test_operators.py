"""Decisions, metrics, validation, files, stages, models and streams."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from kinmesh.config import Config, pool_extra
from kinmesh.functions.text import fold_any, fold_latin, normalise
from kinmesh.operators import blocking, decide, evaluate, features, neighbours, tfidf, training, validate
from kinmesh.plans import fixtures as fx
from kinmesh.plans import linkage
from kinmesh.plans import queries as plans
from kinmesh.sources import readers, writers
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


def pairs(spark, *rows):
    return spark.createDataFrame([(a, b) for a, b in rows], "s1_id string, cand_id string")


def test_decisions(spark):
    rows = [("A", "x", 0.9), ("B", "x", 0.8), ("B", "y", 0.35), ("C", "z", 0.39), ("D", "w", 0.9), ("E", "w", 0.9)]
    scores = spark.createDataFrame(rows, "s1_id string, cand_id string, p double")
    assert {(r.s1_id, r.cand_id) for r in decide.decide(scores, 0.3).collect()} == {("A", "x"), ("B", "y"), ("D", "w")}
    assert decide.decide_v1(scores, 0.36).count() == 5


@pytest.mark.parametrize(("truth", "found", "f"), [("ac", "abc", 0.714286), ("", "", 1), ("", "a", 0), ("a", "", 0), ("a", "b", 0)])
def test_metric(spark, truth, found, f):
    e = spark.createDataFrame([("q",)], "s1_id string")
    make = lambda cands: pairs(spark, *(("q", c) for c in cands))
    assert evaluate.macro(e, make(truth), make(found)).first()["macro_f05"] == pytest.approx(f, abs=1e-6)


def test_losses_sum_to_what_is_missing(spark):
    e, t, p = fx.entities(spark, SF), fx.truth(spark, SF), plans.decided(spark, SF)
    score = evaluate.macro(e, t, p).first()["macro_f05"]
    assert evaluate.loss_breakdown(e, t, p).agg(F.sum("loss")).first()[0] == pytest.approx(1 - score, abs=1e-4)
    assert p.groupBy("cand_id").count().filter("count > 1").isEmpty()


def test_empty_features(spark):
    rows = [("a", "b", "", "", "", ""), ("a", "c", "", "x", "", "1")]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, n1 string, n2 string, a1 string, a2 string")
    got = {r.cand_id: r for r in features.pair_features(df).collect()}
    assert [got["b"][n] for n in ("name_jac", "name_dice", "name_ovl", "name_lr", "name_contain", "name_lev", "name_jw", "anum_match12")] == [1, 1, 0, 1, 1, 1, 1, 1]
    assert [got["c"][n] for n in ("name_jac", "name_dice", "name_ovl", "name_lr", "name_lev", "name_jw", "anum_match12")] == [0, 0, 0, 0, 0, 0, 0.5]
    assert len(features.FEATURE_NAMES) == 48 and len(features.FEATURE_NAMES_V1) == 29
    wide = features.pair_features_modular(df.withColumns({"c1": F.lit("x"), "c2": F.lit("y")}))
    assert len(wide.columns) == 38 and wide.count() == 2


def test_folding(spark):
    df = spark.createDataFrame([("Éßøñ Œuvre",), ("नमस्ते abc",)], "t string")
    assert [r[0] for r in df.select(fold_latin(F.col("t"))).collect()] == ["Essson OEuvre".replace("Essson", "Esson"), "नमस्ते abc"]
    assert df.select(fold_any("t")).collect()[1][0] == " abc"


def test_files_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("S1-00001",), ("S1-00003",), ("S1-00002",)], "s1_id string")
    m = pairs(spark, ("S1-00001", "S3-00812"), ("S1-00001", "S2-00047"), ("S1-00001", "S2-00193"), ("S1-00002", "S3-00004"))
    writers.write_results(e, m, m, str(tmp_path))
    part = next((tmp_path / "matching_results.tsv").glob("part-*"))
    assert part.read_bytes() == b"source1_entity_id\tmatched_entity_ids\nS1-00001\tS2-00047,S2-00193,S3-00812\nS1-00002\tS3-00004\nS1-00003\t\n"
    need = e.withColumnRenamed("s1_id", "entity_id")
    assert validate.validate(spark, f"{tmp_path}/matching_results.tsv", f"{tmp_path}/candidate_pairs.tsv", need, m.select(F.col("cand_id").alias("entity_id"))).isEmpty()
    assert [r.rule for r in validate.validate(spark, f"{tmp_path}/matching_results.tsv", None, need).collect()] == ["ids_not_checked", "candidates_not_checked"]
    assert [r.rule for r in validate.validate(spark, f"{tmp_path}/none.tsv", None, need).collect()] == ["file_missing"]
    (tmp_path / "bad.tsv").write_text("source1_entity_id,matched_entity_ids\n")
    assert [r.rule for r in validate.validate(spark, f"{tmp_path}/bad.tsv", None, need).collect()] == ["comma_header"]
    (tmp_path / "row.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-00001\n")
    assert [r.rule for r in validate.validate(spark, f"{tmp_path}/row.tsv", None, need).collect()] == ["row_without_tab"]
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNone\t"12 Main\tSt."\tFR\nS1-2\tnone\t\tin\n')
    rows = {r.entity_id: r for r in readers.load_source(spark, f"{tmp_path}/s.tsv").collect()}
    assert rows["S1-1"].name_clean == "" and rows["S1-2"].name_clean == "none" and rows["S1-1"].country_norm == "fr"


def test_stages_resume(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.Stages(spark, str(tmp_path), "train", Config(), n=1).stage("a", make).count() == 3
    assert len(made) == 1 and Config().key("train") != Config(seed=1).key("train")
    assert writers.list_runs(spark, str(tmp_path)).filter("finished").count() == 1
    with pytest.warns(UserWarning, match="vectors"):
        linkage.strategies(*fx.normalised(spark, SF), Config(use_char=False, use_word=False))
    with pytest.raises(ValueError, match="score_floor"):
        Config(score_floor=0.5).check_floor(0.3)
    # The same path with other contents is another run: sources and models are told by what they hold.
    spark.range(3).write.parquet(f"{tmp_path}/model")
    before = writers.identity(spark, f"{tmp_path}/model")
    assert before == writers.identity(spark, f"{tmp_path}/model") != writers.identity(spark, f"{tmp_path}/none")
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/model")
    after = writers.identity(spark, f"{tmp_path}/model")
    assert Config().key("predict", model=before) != Config().key("predict", model=after)
    assert writers.clear_all(spark, str(tmp_path), "predict") == 0 and writers.clear_all(spark, str(tmp_path), "train") == 1
    with pytest.raises(ValueError, match="score_floor"):
        Config(score_floor=0.5).check_floor(0.3)
    assert (pool_extra(100, False, None), pool_extra(None, True, None), pool_extra(5, False, 7), pool_extra(5, False)) == (20_000, 500_000, 7, None)


def test_training_and_model_guard(spark, tmp_path):
    s1, pool = (df.cache() for df in fx.normalised(spark, SF))
    config = Config(n_models=2, use_dense=False)
    trained = linkage.run_train(s1, pool, fx.truth(spark, SF), config, writers.Stages(spark, f"{tmp_path}/s", "train", config), grid=((3, 0.3, 5),))
    assert 0 <= trained.score <= 1 and len(trained.importance) == 15
    writers.save_model(spark, trained.models, trained.threshold, features.FEATURE_NAMES, f"{tmp_path}/m")
    models, threshold = readers.load_model(spark, f"{tmp_path}/m", features.FEATURE_NAMES)
    assert threshold == trained.threshold
    with pytest.raises(ValueError, match="features"):
        readers.load_model(spark, f"{tmp_path}/m", ["x"])
    matches, cands = linkage.run_predict(s1, pool, models, max(threshold, 0.2), config, writers.Stages(spark, f"{tmp_path}/p", "predict", config))
    assert matches.join(cands, ["s1_id", "cand_id"], "left_anti").isEmpty()
    scored = spark.createDataFrame([(f"s{i % 5}", f"c{i}", int(i % 10 == 0), i / 100) for i in range(100)], "s1_id string, cand_id string, label int, p double")
    mined = training.mine_hard_negatives(scored, config)
    assert mined.filter("label = 1").count() == 10 and mined.filter("label = 0").count() == 50 and mined.filter("label = 0 AND p >= 0.3").count() >= 30


def test_stream(spark, tmp_path):
    from kinmesh.streaming.matching import match_stream

    df = fx.records(spark, SF).drop("match_key")
    s1 = normalise(fx.first_source(df)).cache()
    fx.secondary(df).write.parquet(f"{tmp_path}/in")
    score = lambda texts: features.pair_features(texts, list(plans.LINEAR)).select("s1_id", "cand_id", F.round(sum((F.col(n) for n in plans.LINEAR[1:]), F.col(plans.LINEAR[0])) / 3, 6).alias("p"))
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    match_stream(stream, s1, score, f"{tmp_path}/out", f"{tmp_path}/cp", threshold=plans.THRESHOLD).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_fields_keep_blanks_at_their_ends(spark, tmp_path):
    rows = [("S1-000001", " a", "666 ", "FR"), ("S1-000002", "b", " ", "\u00a0FR")]
    lists = spark.createDataFrame(rows, readers.RECORD_SCHEMA)
    writers.write_tsv(lists, f"{tmp_path}/f.tsv")
    assert sorted(map(tuple, readers.read_tsv(spark, f"{tmp_path}/f.tsv").collect())) == rows


def test_scan_of_short_texts(spark, tmp_path):
    """An address without words and ending is a number and a blank."""
    spark.createDataFrame([(3, "one two", "fr"), (7, "one", "fr"), (11, "a b c d e", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert same_rows(plans.QUERIES["src_tsv_scan"](spark, str(tmp_path)), con, plans.SQL["src_tsv_scan"]) == 3


def test_prefilter_ranks_by_rounded_scores(spark):
    """The three scores are 0.667143 to six places and differ in the last bit; the smallest id is the least of them unrounded."""
    texts = [("S1-1", "abcabca", "abcabca"), ("S2-1", "bcbc", "abcaab"), ("S2-2", "aaccba", "abcaab"), ("S2-3", "abacbc", "aba")]
    records = spark.createDataFrame(texts, "entity_id string, name_clean string, addr_clean string")
    some = pairs(spark, ("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-3"))
    for cap in (1, 2):
        kept = blocking.prefilter(some, fx.first_source(records), fx.secondary(records), cap=cap)
        assert [r.cand_id for r in kept.orderBy("cand_id").collect()] == ["S2-1", "S2-2"][:cap]


def test_tfidf_in_blocks(spark):
    """Blocks of any size give the same rows, with a vocabulary sent to the workers or joined, and no pairs are shuffled."""
    rows = [(f"S{1 + i % 3}-{i:06}", f"name{i % 7} word{i % 11} of{i % 5}", "fr" if i % 4 else "en") for i in range(120)] + [("S1-000000", "name1 more", "en"), ("S2-000777", "", "en"), ("S2-000778", None, None)]
    records = spark.createDataFrame(rows, "entity_id string, combined string, country_norm string")
    s1, pool = fx.first_source(records), fx.secondary(records)
    index = tfidf.fit(pool, max_df=None)
    whole = tfidf.query(s1, index, k=7)
    assert not re.search(r"hashpartitioning\(s1_id#\d+, cand_id", whole._jdf.queryExecution().toString())
    expected = sorted(whole.collect())
    assert {r.s1_id for r in expected} == {r.entity_id for r in s1.collect()} and max(r["rank"] for r in expected) == 7
    assert sorted(tfidf.query(s1, index, k=7, left_rows=9, right_rows=4).collect()) == expected
    joined = tfidf.query(s1, tfidf.fit(pool, max_df=None, max_features=None), k=7, right_rows=30)
    assert [tuple(r)[:3] for r in sorted(joined.collect())] == [tuple(r)[:3] for r in expected]


def test_token_overlap_in_blocks(spark):
    """Against all pairs; blocks of any size give the same, and no pairs are shuffled."""
    rows = [(f"S{1 + i % 3}-{i:06}", [f"t{i % 4}", f"u{i % 7}", f"v{i % 5}"][: i % 4], [str(i % 6), str(i % 9)][: i % 3], "fr" if i % 4 else "en") for i in range(150)] + [("S2-000900", ["t1", "u1"], ["1"], None)]
    records = spark.createDataFrame(rows, "entity_id string, name_tokens array<string>, addr_nums array<string>, country_norm string")
    enough = lambda a, b: len(set(a[1]) & set(b[1])) >= 1 and len(set(a[2]) & set(b[2])) >= 1 if a[2] and b[2] else len(set(a[1]) & set(b[1])) >= 2
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < "S2" <= b[0] and a[3] == b[3] and enough(a, b))
    s1, pool = fx.first_source(records), fx.secondary(records)
    for size in ({}, {"left_rows": 11, "right_rows": 6}):
        found = blocking.token_overlap(s1, pool, **size)
        assert sorted(map(tuple, found.collect())) == expected and len(expected) > 100
        assert not re.search(r"hashpartitioning\(s1_id#\d+, cand_id", found._jdf.queryExecution().toString())


def test_similar_in_blocks(spark):
    """Against all pairs; blocks of any size give the same, and no pairs are shuffled."""
    rows = [(f"S{1 + i % 3}-{i:06}", f"name{i % 7} of word{i % 11}"[: i % 20], "fr" if i % 4 else "en") for i in range(150)] + [("S2-000900", "name1", None)]
    records = spark.createDataFrame(rows, "entity_id string, combined string, country_norm string")
    sets = {r[0]: {r[1][n : n + 3] for n in range(len(r[1]) - 2)} for r in rows}
    of = lambda a, b: len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1)
    expected = sorted((a[0], b[0], round(of(a[0], b[0]), 6)) for a in rows for b in rows if a[0] < "S2" <= b[0] and a[2] == b[2] and of(a[0], b[0]) >= 0.6)
    for size in ({}, {"left_rows": 11, "right_rows": 6}):
        found = neighbours.lsh_similar(fx.first_source(records), fx.secondary(records), at_least=0.6, **size)
        assert sorted(map(tuple, found.collect())) == expected and len(expected) > 50
        assert not re.search(r"hashpartitioning\(s1_id#\d+, cand_id", found._jdf.queryExecution().toString())

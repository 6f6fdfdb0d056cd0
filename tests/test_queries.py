"""Queries against their SQL on the smallest tables."""

import pytest

from kinmesh.plans import io_queries  # noqa: F401
from kinmesh.plans import queries as plans
from tests.conftest import duck, same_rows

SF = "/root/testdata/sf0.001"
NAMES = [
    "norm_name_clean", "norm_addr_clean", "legal_map_replace", "domain_strip", "norm1_names", "norm1_keys", "norm_chain", "match_lists", "pool_sampled", "block_union", "block_token_overlap", "block_v1_keys",
    "tfidf_char_topk", "tfidf_word_topk", "prefilter_ranked", "prefilter_topk", "prefilter_top100", "blocking_report", "minhash_similar", "dense_topk_exact", "recall_unique_by_strategy", "cap_recall_curve", "feat_sets", "feat_lev", "feat_numbers", "feat_jaro_winkler", "decide_full",
    "tune_threshold", "pr_curve", "f05_per_entity", "loss_breakdown", "country_rollup", "match_histogram", "val_duplicate_id", "val_unknown_id", "train_pairs", "train_split",
    "feat_indel_suite", "feat_phonetic", "feat_v1_36", "src_tsv_scan", "src_country_scan", "src_union_pool", "snk_embedding_cache", "snk_saved_index", "snk_stage_resume", "snk_runs", "val_files", "train_hard_negatives", "translit_indic", "val_unknown_row", "val_self_match", "blocking_report_final", "first_candidates",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    same_rows(plans.QUERIES[name](spark, SF), con, plans.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lsh_finds_what_exact_retrieval_finds(spark):
    exact = plans.QUERIES["dense_topk_exact"](spark, SF).select("s1_id", "cand_id")
    near = plans.QUERIES["dense_topk_lsh"](spark, SF).select("s1_id", "cand_id")
    best = exact.filter("s1_id = cand_id")
    assert best.join(near, ["s1_id", "cand_id"], "left_anti").count() == 0


def test_lsh_recall(spark):
    exact = plans.QUERIES["dense_topk_exact"](spark, SF).select("s1_id", "cand_id").cache()
    near = plans.QUERIES["dense_topk_lsh"](spark, SF)
    assert exact.join(near, ["s1_id", "cand_id"], "left_semi").count() >= 0.9 * exact.count() > 0
    assert near.groupBy("s1_id").count().filter("count > 10").isEmpty() and near.dropDuplicates(["s1_id", "cand_id"]).count() == near.count()


def test_partitioning_does_not_matter(spark):
    a = plans.QUERIES["tfidf_char_topk"](spark, SF).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(a) == sorted(plans.QUERIES["tfidf_char_topk"](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

"""Pairs on keys: each once, no task with all of a key, nothing scored twice."""

import random
import re

from pyspark.sql import functions as F

from kinmesh.functions import batch, kernels, text
from kinmesh.operators import blocking, evaluate, features, training
from kinmesh.config import Config
from kinmesh.plans import fixtures as fx
from kinmesh.plans import queries as plans

RECORDS = "entity_id string, country_norm string, name_clean string, addr_clean string, addr_nums_str string, name_sorted_3tok string"


def _records(rng, n, prefix):
    names = ["acme one", "acme two", "bolt x", "ab", "", "acme one"]
    rows = []
    for i in range(n):
        name, nums = rng.choice(names), rng.choice(["", "1", "1 2"])
        rows.append((f"{prefix}-{i}", rng.choice(["fr", "in", None]), name, f"{nums} road", nums, " ".join(sorted(name.split())[:3]) if " " in name else ""))
    return rows


def test_each_pair_once_with_all_its_strategies(spark):
    rng = random.Random(1)
    left, right = _records(rng, 60, "S1"), _records(rng, 90, "S2")
    # An id may have several records.
    left, right = left + [(left[0][0], "fr", "bolt x", "1 road", "1", "bolt x")], right + [(right[0][0], "in", "acme two", "", "", "acme two"), right[1]]
    s1, pool = spark.createDataFrame(left, RECORDS), spark.createDataFrame(right, RECORDS)
    keys = {"prefix5": lambda r: r[2][:5] if len(r[2]) >= 3 else None, "prefix4": lambda r: r[2][:4] if len(r[2]) >= 3 else None, "sorted3": lambda r: r[5] or None, "addr_nums": lambda r: r[4] or None}
    expected = {}
    for name, key in keys.items():
        buckets = {}
        for r in sorted(right):
            if r[1] and key(r):
                buckets.setdefault((r[1], key(r)), []).append(r[0])
        for r in left:
            for c in buckets.get((r[1], key(r)), [])[:7]:
                expected.setdefault((r[0], c), set()).add(name)
    got = blocking.key_pairs(s1, pool, 7).collect()
    assert len(got) == len(expected) and {(r.s1_id, r.cand_id): set(r.found) for r in got} == expected
    for name in keys:
        assert sorted(map(tuple, blocking.key_pairs(s1, pool, 7, name).select("s1_id", "cand_id").collect())) == sorted(p for p, found in expected.items() if name in found)


def test_a_hot_key_is_no_single_task(spark):
    side = lambda n, p: spark.range(n).select(F.format_string(f"{p}-%d", "id").alias("entity_id"), F.lit("fr").alias("country_norm"), F.lit("acme one").alias("name_clean"))
    pairs = blocking.block_on_key(side(4000, "S1"), side(300, "S2"), F.col("name_clean"), F.lit(True))
    parts = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 400_000 and max(parts) <= 200_000


def test_addr_nums_keeps_all_partners_of_a_key(spark, monkeypatch):
    """no cap, and a key with many records on both sides is dealt in chunks of both."""
    side = lambda n, p: spark.range(n).select(F.format_string(f"{p}-%d", "id").alias("entity_id"), F.lit("fr").alias("country_norm"), F.lit("acme").alias("name_clean"), F.lit("").alias("name_sorted_3tok"), (F.col("id") % 2).cast("string").alias("addr_nums_str"))
    monkeypatch.setattr(plans.fx, "stored_records", lambda *_: (side(300, "S1"), side(500, "S2")))
    monkeypatch.setattr(blocking, "WIDE", 60)
    pairs = plans.QUERIES["block_addr_nums"](spark, "")
    expected = {(f"S1-{i}", f"S2-{j}") for i in range(300) for j in range(500) if i % 2 == j % 2}
    got = list(map(tuple, pairs.collect()))
    assert len(got) == len(expected) and set(got) == expected
    assert max(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()) < len(expected) / 2
    assert "r <= 100" not in plans.SQL["block_addr_nums"] and all("r <= 100" in plans.SQL[f"block_{k}"] for k in ("prefix5", "prefix4", "sorted3", "union"))


def test_unbounded_keys_against_brute_force(spark, monkeypatch):
    """Chunks of both sides, ids with several records, several strategies: each pair once."""
    rng = random.Random(4)
    left, right = _records(rng, 80, "S1"), _records(rng, 120, "S2")
    left, right = left + [(left[0][0], "fr", "bolt x", "1 road", "1", "bolt x")], right + [(right[0][0], "in", "acme two", "", "1 2", "acme two"), right[1]]
    monkeypatch.setattr(blocking, "WIDE", 5)
    key = {"prefix5": lambda r: r[2][:5] if len(r[2]) >= 3 else None, "prefix4": lambda r: r[2][:4] if len(r[2]) >= 3 else None, "sorted3": lambda r: r[5] or None, "addr_nums": lambda r: r[4] or None}
    s1, pool = spark.createDataFrame(left, RECORDS), spark.createDataFrame(right, RECORDS)
    for names in (("addr_nums",), tuple(key)):
        expected = {(a[0], b[0]) for a in left for b in right if a[1] and a[1] == b[1] and any(key[n](a) and key[n](a) == key[n](b) for n in names)}
        got = [tuple(r) for r in blocking.key_pairs(s1, pool, None, names[0] if len(names) == 1 else None).select("s1_id", "cand_id").collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_hard_negatives_score_each_pair_once(spark):
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def p(i):
        scored.add(1)
        return (i % 10) / 10

    pairs = spark.range(500).select(F.concat(F.lit("S1-"), F.col("id") % 40).alias("s1_id"), F.concat(F.lit("S2-"), F.col("id")).alias("cand_id"), (F.col("id") % 20 == 0).cast("int").alias("label"), p("id").alias("p"))
    mined = training.mine_hard_negatives(pairs, Config())
    assert mined.count() == mined.count() and scored.value == 500


def test_report_of_pairs_equals_report_of_strategies(spark):
    pair = "s1_id string, cand_id string"
    sets = {"a": [("x", "1"), ("x", "2"), ("y", "1")], "b": [("x", "2"), ("z", "9")]}
    sets = {name: spark.createDataFrame(rows, pair) for name, rows in sets.items()}
    entities, truth = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "s1_id string"), spark.createDataFrame([("x", "1"), ("x", "2"), ("z", "8")], pair)
    rows = {r["strategy"]: tuple(r)[1:] for r in evaluate.blocking_report(entities, truth, sets, sets["b"]).collect()}
    assert rows == {"a": (0.666667, 0.5, 0.75, 1.85), "b": (0.333333, 0.0, 0.5, 1.0), "UNION": (0.666667, 0.5, 1.0, 1.85), "FINAL": (0.333333, 0.0, 0.5, 1.0)}
    pairs = evaluate.found_by(blocking.tagged(sets))
    assert {tuple(r) for r in evaluate.unique_recall_of(truth, pairs).collect()} == {tuple(r) for r in evaluate.unique_recall(truth, blocking.tagged(sets)).collect()} == {("a", 0.333333), ("b", 0.0)}


def test_pairs_are_not_grouped_or_looked_up(spark):
    """Whatever the query, pairs leave the join with their texts: no exchange by pair or by record follows it."""
    sf = "/root/testdata/sf0.001"
    for name in ("block_union", "block_addr_nums", "feat_v1_29", "feat_v1_36", "feat_all_48", "score_linear"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 1 and "Aggregate" not in plan, name


def test_long_strings_go_in_blocks(monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randint(40, 256)))
    pairs = [(word(), word()) for _ in range(300)] + [("a" * 256, "a" * 256), ("", "b" * 80), ("ab" * 64, "ba" * 64)]
    expected = [kernels.jaro_winkler(a, b) for a, b in pairs]
    monkeypatch.setattr(kernels, "jaro_winkler", None)
    got = batch.jaro_winkler(*map(list, zip(*pairs, strict=True)))
    assert max(abs(x - y) for x, y in zip(got, expected, strict=True)) < 1e-12


def test_nested_replacements_stay_small(spark):
    def size(depth):
        c = F.col("t")
        for _ in range(depth):
            c = text.map_replace(c, {"a": "b"}, bounded=True)
        return len(spark.createDataFrame([("a a",)], "t string").select(c)._jdf.queryExecution().optimizedPlan().toString())

    assert size(6) < 6 * size(2)


def test_texts_are_not_cut_into_tokens_for_each_pair(spark):
    """Edit distances and counts of sets come with the Arrow pass, where a text is cut up once a batch."""
    for name in ("feat_v1_29", "feat_v1_36", "score_linear"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "levenshtein(" not in plan and "regexp_extract_all" not in plan and "MapInArrow" in plan, name


def test_cheap_score_cuts_no_text_up_for_each_pair(spark):
    rows = [("a", "b", "acme one", "acme two one", "1 road", "1 road"), ("a", "c", "", "", "", ""), ("a", "d", "x", "", "1", ""), ("a", "e", "x\u00a0y", "x", "1", "1")]
    scored = blocking.cheap_score(spark.createDataFrame(rows, "s1_id string, cand_id string, n1 string, n2 string, a1 string, a2 string"))
    assert "array_distinct" not in scored._jdf.queryExecution().optimizedPlan().toString()
    share = [1.0, 1.0, 0.0, 0.0]
    expected = [0.45 * kernels.jaro_winkler(r[2], r[3]) + 0.30 * kernels.jaro_winkler(r[4], r[5]) + 0.25 * x for r, x in zip(rows, share, strict=True)]
    assert [r.score for r in scored.orderBy("cand_id").collect()] == [round(x * 1e6) / 1e6 for x in expected]


def test_features_of_names_read_no_addresses(spark):
    """What is made of names alone carries no address with a pair, and is the same as beside features of addresses."""
    rows = [("a", "b", "acme one", "acme two one", "1 road", "2 road"), ("a", "c", "", "", "", ""), ("a", "d", "x y", "x", "1", "")]
    texts = spark.createDataFrame(rows, "s1_id string, cand_id string, n1 string, n2 string, a1 string, a2 string")
    names = [n for n in features.FEATURE_NAMES if n.startswith(("name_", "phon_"))]
    alone, beside = features.pair_features(texts, names), features.pair_features(texts, [*names, "addr_lev"]).drop("addr_lev")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, beside.collect()))
    assert [c for c in features.kernel_pass(texts, ["name_lev"], ["s1_id", "n1"]).columns] == ["s1_id", "n1", "name_lev"]
    plan = plans.linear_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"\ba[12]#", plan.split("MapInArrow")[1].split("Join")[0])


def test_documents_are_read_once(spark):
    """Records, truth and entities are made of words that were cut once: no plan of theirs reads the documents again."""
    sf = "/root/testdata/sf0.001"
    reads = lambda df: len(re.findall(r"FileScan parquet[^\n]*documents\.parquet", df._jdf.queryExecution().executedPlan().toString()))
    x = fx.words(spark, sf)
    for df in (fx.records(spark, sf, x), fx.truth(spark, sf, x), fx.entities(spark, sf, x), *fx.stored_records(spark, sf, x), fx.records(spark, sf), plans.QUERIES["recall_pair_entity"](spark, sf), plans.QUERIES["pr_curve"](spark, sf)):
        assert reads(df) == 0
    assert reads(spark.read.parquet(f"{sf}/documents.parquet").select("text")) == 1

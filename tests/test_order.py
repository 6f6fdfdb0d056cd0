"""Running sums and smallest rows without a single task, romanisation, long lists in validation, embeddings by text, timings."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinmesh.config import Config
from kinmesh.functions import scripts, text
from kinmesh.operators import decide, neighbours, order, training, validate
from kinmesh.plans import fixtures as fx
from kinmesh.plans import linkage

SF = "/root/testdata/sf0.001"


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(float(p), int(c)) for p, c in zip(rng.integers(0, 60, 500) / 60, rng.integers(0, 5, 500), strict=True)]
    df = spark.createDataFrame(rows, "p double, c long").repartition(5)
    out, total = order.running(df, [F.desc("p")], {"s": "c"})
    want = {p: sum(c for q, c in rows if q >= p) for p, _ in rows}
    assert {r.p: r.s for r in out.collect()} == want and total == {"s": sum(c for _, c in rows)} and out.count() == 500
    assert order.running(df.limit(0), [F.desc("p")], {"s": "c"})[0].isEmpty()


def test_curve_has_no_single_task(spark):
    rows = [(i % 97 / 97, int(i % 7 == 0)) for i in range(1000)]
    curve = decide.pr_curve(spark.createDataFrame(rows, "p double, label int"))
    assert "SinglePartition" not in curve._jdf.queryExecution().executedPlan().toString()
    for r in curve.collect():
        n, tp = sum(p >= r.threshold for p, _ in rows), sum(y for p, y in rows if p >= r.threshold)
        assert r.precision == pytest.approx(tp / n, abs=1e-6) and r.recall == pytest.approx(tp / sum(y for _, y in rows), abs=1e-6)
    assert decide.pr_curve(spark.createDataFrame([], "p double, label int")).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 7, 1500, 2999, 3000, 5000])
def test_smallest_rows(spark, monkeypatch, n):
    monkeypatch.setattr(order, "FEW", 3)
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("o"), F.col("id").alias("t"))
    for parts in (1, 6):
        got = order.smallest(df.repartition(parts), "o", ["t"], n)
        assert sorted(got.collect()) == sorted(df.orderBy("o", "t").limit(n).collect())
    same = df.withColumn("o", F.md5(F.lit("x")))
    assert sorted(order.smallest(same, "o", ["t"], n).collect()) == same.orderBy("t").limit(n).collect()


def test_hard_negatives_whatever_the_partitions(spark):
    rows = [(f"s{i % 50}", f"c{i}", int(i % 40 == 0), (i % 100) / 100) for i in range(4000)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, p double")
    a, b = (sorted(training.mine_hard_negatives(df.repartition(k), Config()).collect()) for k in (1, 9))
    assert a == b and sum(r.label for r in a) == 100 and len(a) == 600


def test_validation_in_linear_time(spark):
    ids = [f"S2-{i}" for i in range(100_000)]
    lists = spark.createDataFrame([("S1-1", ",".join(ids + ids[:3])), ("S1-1", "S2-1,S2-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    found = validate.check_lists(lists, need).filter("rule = 'duplicate_id'").collect()
    assert sorted(r.detail for r in found) == ["S2-0,S2-1,S2-2", "S2-1"]
    many = spark.range(1_000_000).select(F.when(F.col("id") >= 0, "unknown_id").alias("rule"), F.when(F.col("id") >= 0, "error").alias("severity"), F.lpad(F.col("id").cast("string"), 8, "0").alias("entity_id"), F.lit("").alias("detail"))
    shown = validate.messages(many)
    (row,) = shown.collect()
    assert row.n == 1_000_000 and row.examples == [f"{i:08d}" for i in range(5)]
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()


# Names in other scripts and how they are read in Latin letters.
READ = (
    ("राम", "ram"), ("नमस्ते", "namaste"), ("भारत लिमिटेड", "bharat ltd"), ("दिल्ली", "dilli"), ("कृष्ण", "krishn"), ("हिंदी", "hindi"), ("ಕನ್ನಡ", "kannada"), ("ಬೆಂಗಳೂರು", "bengaluru"),
    ("தமிழ்", "tamil"), ("కృష్ణ", "krishna"), ("বাংলা", "banla"), ("१२ मार्ग", "12 marg"), ("Москва", "moskva"), ("Щербаков", "shcherbakov"), ("Αθήνα", "athina"), ("café", "cafe"), ("plain", "plain"),
)


def test_other_scripts(spark):
    df = spark.createDataFrame([(a,) for a, _ in READ] + [(None,)], "t string")
    got = [r.x for r in df.select(text.clean_name(F.col("t")).alias("x")).collect()]
    assert dict(zip([a for a, _ in READ], got, strict=False)) == dict(READ) and got[-1] == ""
    kept = df.select(text.clean_name(F.col("t"), transliterate=False).alias("x")).first().x
    assert kept == "राम"
    assert df.select(scripts.romanised(F.col("t")).alias("x")).filter("t IS NULL AND x IS NULL").count() == 1


def test_setting_turns_it_off(spark, tmp_path):
    from kinmesh.sources import readers

    (tmp_path / "s.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tराम\tx\tin\n")
    path = f"file://{tmp_path}/s.tsv"
    assert readers.load_country(spark, path, "in").first().name_clean == "ram"
    assert readers.load_country(spark, path, "in", transliterate=Config(transliterate=False).transliterate).first().name_clean == "राम"


def test_embeddings_by_text(spark, tmp_path):
    asked = []

    def encode(rows):
        asked.append(sorted(r.combined for r in rows.collect()))
        return rows.select("entity_id", F.array(F.length("combined").cast("float")).alias("embedding"))

    rows = [("a", "x", "one"), ("b", "x", "three"), ("c", "y", "three"), ("d", None, None)]
    frame = lambda r: spark.createDataFrame(r, "entity_id string, country_norm string, combined string")
    take = lambda r, name: {x.entity_id: x.embedding for x in linkage.encoded(frame(r), encode, f"file://{tmp_path}", encoder=name).collect()}
    assert take(rows, "m1") == {"a": [3.0], "b": [5.0], "c": [5.0], "d": [0.0]} and asked == [["", "one", "three"]]
    rows[0] = ("a", "x", "changed")
    assert take(rows, "m1")["a"] == [7.0] and asked[1:] == [["changed"]]
    assert take(rows[1:], "m1") and len(asked) == 2
    assert take(rows, "m2") and asked[2:] == [["", "changed", "three"]]
    (tmp_path / next(p.name for p in tmp_path.iterdir())).joinpath("segment-torn").mkdir()
    assert len(take(rows, "m1")) == 4 and linkage.encoded(frame([]), encode, f"file://{tmp_path}", encoder="m3").isEmpty()


def test_bands_are_counted_in_blocks(spark):
    records = fx.normalised(spark, SF)
    banded = [neighbours.with_bands(df, text="combined", permutations=32, threshold=0.3, ngram=3).select("entity_id", "country_norm", F.explode("bands").alias("band")) for df in records]
    plain = banded[0].withColumnRenamed("entity_id", "s1_id").join(banded[1].withColumnRenamed("entity_id", "cand_id"), ["country_norm", "band"]).groupBy("s1_id", "cand_id").count()
    want = sorted(map(tuple, plain.collect()))
    for size in ({}, {"left_rows": 20, "right_rows": 30}):
        assert sorted(map(tuple, neighbours.lsh_pairs(*records, permutations=32, cap=None, **size).collect())) == want and len(want) > 50
    capped = neighbours.lsh_pairs(*records, permutations=32, cap=3, left_rows=20, right_rows=30).collect()
    best = {s: sorted((-n, c) for x, c, n in want if x == s)[:3] for s in {x for x, _, _ in want}}
    assert sorted(map(tuple, capped)) == sorted((s, c, -n) for s, v in best.items() for n, c in v)


def test_pairs_by_bands_find_similar_ones(spark):
    """Against all pairs of sf0.01: of those at 0.3 nine in ten, of those at 0.5 all."""
    s1, pool = fx.normalised(spark, "/root/testdata/sf0.01")
    sets = [[(r.entity_id, r.country_norm, {r.combined[n : n + 3] for n in range(len(r.combined) - 2)}) for r in df.collect()] for df in (s1, pool)]
    alike = {(a, b): len(x & y) / len(x | y) for a, c, x in sets[0] for b, d, y in sets[1] if c == d and x and y}
    found = {(r.s1_id, r.cand_id) for r in neighbours.lsh_pairs(s1, pool).collect()}
    for least, share in ((0.3, 0.9), (0.5, 1.0)):
        close = {p for p, v in alike.items() if v >= least}
        assert len(close & found) >= share * len(close) > 50


def test_timings_come_from_the_run(spark):
    s1, pool = fx.normalised(spark, SF)
    timings = linkage.Timings()
    found = linkage.strategies(s1, pool, Config(use_dense=False, use_word=False, use_keys=True), timed=timings)
    frame = {r.strategy: r for r in timings.frame(spark, s1.count()).collect()}
    assert set(frame) == {*found, "UNION"} and frame["char_tfidf"].build_seconds > 0 and all(r.ms_per_query > 0 for r in frame.values())
    assert found["char_tfidf"].count() > 0


def test_least_hashes_are_those_of_spark(spark):
    """The least xxhash64(x, seed) of a text's shingles, without a row for each shingle; what has no shingles has no signature."""
    rows = [("a", "fr", "acme one"), ("b", "in", "ab"), ("c", "in", None), ("d", None, "wörd ß 日本語 aaaa"), ("e", "fr", "x" * 300 + "yz"), ("e", "fr", "second row")]
    records = spark.createDataFrame(rows, "entity_id string, country_norm string, combined string")
    grams = records.select("entity_id", F.explode(neighbours.shingles(F.col("combined"))).alias("x")).groupBy("entity_id")
    want = {r[0]: list(r[1:]) for r in grams.agg(*(F.min(F.xxhash64("x", F.lit(p))).alias(f"m{p}") for p in range(9))).collect()}
    got = neighbours.minhash(records, permutations=9)
    assert {r.entity_id: r.signature for r in got.collect()} == want and set(want) == {"a", "d", "e"}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_pairs_are_met_by_band(spark, monkeypatch):
    """Near copies of many similarities, and ids that two countries share, against all pairs; whole sets are compared for few pairs besides those that are found."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 30)))
    texts = [" ".join(word() for _ in range(6)) for _ in range(60)]
    near = lambda t: "".join(c if rng.random() > 0.05 else rng.choice("xyz ") for c in t)
    rows = [(i, near(t), rng.choice(("fr", "en"))) for _ in range(4) for i, t in enumerate(texts)]
    left, right = ([(f"{p}-{i}", t, c) for i, t, c in part] for p, part in (("S1", rows[:120]), ("S2", rows[120:])))
    grams = lambda t: {t[n : n + 3] for n in range(len(t) - 2)}
    of = lambda a, b: len(grams(a) & grams(b)) / max(len(grams(a) | grams(b)), 1)
    want = sorted((a[0], b[0], round(of(a[1], b[1]), 6)) for a in left for b in right if a[2] == b[2] and of(a[1], b[1]) >= 0.6)
    frames = [spark.createDataFrame(x, "entity_id string, combined string, country_norm string") for x in (left, right)]
    for size in ({}, {"left_rows": 30, "right_rows": 20}):
        assert sorted(map(tuple, neighbours.lsh_similar(*frames, at_least=0.6, **size).collect())) == want and len(want) > 20
    compared = []
    sets = neighbours._sets
    monkeypatch.setattr(neighbours, "_sets", lambda texts, rows, ngram: compared.append(len(rows)) or sets(texts, rows, ngram))
    monkeypatch.setattr(neighbours.blocks, "CELLS", 50)
    a, b = (pa.Table.from_batches(_one_block(f)) for f in frames)
    found = neighbours._alike(0.6, 3)(a, b)
    assert len(set(zip(found["s1_id"].to_pylist(), found["cand_id"].to_pylist(), strict=True))) >= len({w[:2] for w in want})
    assert sum(compared) / 2 < 3 * found.num_rows < len(left) * len(right) / 10


def _one_block(frame):
    """A side's sketches, all countries as one block."""
    sets = frame.select(F.col("entity_id").alias("id"), F.lit("fr").alias("country_norm"), F.col("combined").alias("text"), neighbours._hashes(neighbours.shingles(F.col("combined"))).alias("h"))
    return neighbours.sketches(sets, 128, 3).toArrow().to_batches()

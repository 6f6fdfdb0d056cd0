import random

import pytest

from kinmesh import cli
from kinmesh.config import Config
from kinmesh.operators import features, tfidf, training
from kinmesh.operators.boosting import Settings
from kinmesh.plans import first_generation, linkage
from kinmesh.sources import readers, writers

WORDS = "acme bolt cedar delta ember falcon grove harbor iron jasper kestrel lumen maple north onyx pearl quartz river stone timber".split()
SMALL = Settings(2, 0.5, 3, least_hessian=0.5, patience=2)


def tsv(path, header, rows):
    path.write_text("\n".join("\t".join(r) for r in [header, *rows]) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Training and test files; names of the pool vary in legal form and letters, and one record has nothing but an id and a country."""
    root, rng = tmp_path_factory.mktemp("linkage"), random.Random(3)
    head = ("entity_id", "business_name", "business_address", "country")
    for kind in ("train", "test"):
        ones, twos, threes, truth = [], [], [], []
        for i in range(48):
            name = " ".join(rng.sample(WORDS, 3))
            place, country = f"{rng.randrange(1, 900)} {rng.choice(WORDS)}", rng.choice(("US", "India"))
            ones.append((f"S1-{i}", f"{name} Corporation", f"{place} Street", country))
            matched = []
            if i % 5:
                twos.append((f"S2-{i}", f"{name} corp", f"{place} St", country))
                matched.append(f"S2-{i}")
            if i % 3 == 0:
                threes.append((f"S3-{i}", name.replace("e", "é").upper(), f"{place} street", country))
                matched.append(f"S3-{i}")
            threes.append((f"S3-n{i}", " ".join(rng.sample(WORDS, 2)), f"{rng.randrange(900)} {rng.choice(WORDS)} road", country))
            truth.append((f"S1-{i}", ",".join(matched)))
        twos.append(("S2-none", "", "", "US"))
        for name, rows in (("source1", ones), ("source2", twos), ("source3", threes)):
            tsv(root / f"{kind}_{name}.tsv", head, rows)
        tsv(root / f"{kind}_ground_truth.tsv", ("source1_entity_id", "matched_entity_ids"), truth)
    return root


def brute_threshold(rows):
    """The lowest of the thresholds with the best F0.5 of pairs."""
    best = (-1.0, 0.0)
    for t in sorted({r.p for r in rows}):
        taken = [r.label for r in rows if r.p >= t]
        tp, total = sum(taken), sum(r.label for r in rows)
        precision, recall = tp / len(taken), tp / total if total else 0.0
        f = round(1.25 * precision * recall / (0.25 * precision + recall), 6) if tp else 0.0
        if f > best[0]:
            best = (f, t)
    return best[1]


@pytest.mark.parametrize("generation", [0, 1])
def test_run(spark, folder, tmp_path, monkeypatch, generation):
    monkeypatch.setattr(training, "SINGLE_V1", SMALL)
    config = Config()
    s1, pool, truth = (df.cache() for df in linkage.load_training(spark, cli._paths(str(folder), "train"), config, None, generation=generation))
    stages = writers.Stages(spark, f"file://{tmp_path}", "train", config)
    trained = first_generation.run_train(s1, pool, truth, generation, config, stages)

    found = {(r.s1_id, r.cand_id) for r in stages.stage("candidates", None).collect()}
    similar = {(r.s1_id, r.cand_id) for r in tfidf.retrieve_v1(s1, pool, k=20).collect()}
    key = (lambda r: r.name_clean[:5] if len(r.name_clean) > 2 else None) if generation else (lambda r: r.name_key or None)
    nums = (lambda r: r.addr_nums_str or None) if generation else (lambda r: tuple(sorted(r.addr_nums)[:3]) or None)
    a, b = s1.collect(), pool.collect()
    keyed = {(x.entity_id, y.entity_id) for x in a for y in b for k in (key, nums) if k(x) is not None and k(x) == k(y) and x.country_norm == y.country_norm}
    assert found == similar | keyed and keyed - similar

    labelled = training.predict(stages.stage("pairs", None), trained.models).collect()
    true = {(r.s1_id, r.cand_id) for r in truth.collect()}
    assert {(r.s1_id, r.cand_id) for r in labelled if r.label} == found & true and len(labelled) < len(found)
    held = {r.s1_id for r in stages.stage("split", None).filter("validation").collect()}
    assert trained.threshold == brute_threshold([r for r in labelled if r.validation])
    scores = {(r.s1_id, r.cand_id): r.p for r in stages.stage("scores", None).collect()}
    assert set(scores) == {p for p in found if p[0] in held}
    taken = {p for p, v in scores.items() if v >= trained.threshold}
    known = {p for p in true if p[0] in held}
    report = trained.report
    assert (report["true_positives"], report["false_positives"], report["false_negatives"]) == (len(taken & known), len(taken - known), len(known - taken))
    assert report["pair_recall"] == pytest.approx(len(found & known) / len(known), abs=1e-6)
    fs = []
    for e in held:
        t, p = {c for s, c in known if s == e}, {c for s, c in taken if s == e}
        hit = len(t & p)
        fs.append(1.0 if not t and not p else 0.0 if not hit else 1.25 * (hit / len(p)) * (hit / len(t)) / (0.25 * hit / len(p) + hit / len(t)))
    assert trained.score == pytest.approx(sum(fs) / len(fs), abs=2e-6) and trained.score > 0.5
    assert len(trained.importance) == (10 if generation else 15)


def test_features_and_empty_sides(spark, folder):
    for generation, n in ((0, 36), (1, 29)):
        s1, pool, _ = linkage.load_training(spark, cli._paths(str(folder), "train"), Config(), None, generation=generation)
        pairs = spark.createDataFrame([("S1-0", "S2-none"), ("S1-1", "S2-1"), ("S1-1", "unknown")], "s1_id string, cand_id string")
        df = first_generation.pair_features(pairs, s1, pool, generation)
        assert df.columns[2:] == first_generation.NAMES[generation] and len(df.columns) == n + 2
        assert {(r.s1_id, r.cand_id) for r in df.collect()} == {("S1-0", "S2-none"), ("S1-1", "S2-1")}
        assert first_generation.candidates(s1.limit(0), pool, generation).isEmpty() and first_generation.candidates(s1, pool.limit(0), generation).isEmpty()
    assert set(features.FEATURE_NAMES_V1) <= set(features.FEATURE_NAMES)


def test_sampled_pool(spark, folder):
    paths = cli._paths(str(folder), "train")
    for generation in (0, 1):
        s1, pool, truth = linkage.load_training(spark, paths, Config(), 5, generation=generation)
        assert s1.count() == 5 and truth.join(pool.withColumnRenamed("entity_id", "cand_id"), "cand_id", "left_anti").isEmpty()


def test_command_line(spark, folder, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(training, "SINGLE_V1", SMALL)
    monkeypatch.setenv("KINMESH_CHECKPOINT_DIR", f"file://{tmp_path}/runs")
    model, out = f"file://{tmp_path}/model", f"file://{tmp_path}/out"
    assert cli.main(["full", "--train-dir", str(folder), "--test-dir", str(folder), "--model", model, "--out", out, "--generation", "1"]) == 0
    printed = capsys.readouterr().out
    assert "held-out macro F0.5" in printed and "pair_recall" in printed
    rows = {r.source1_entity_id: r.matched_entity_ids for r in readers.read_tsv(spark, f"{out}/matching_results.tsv", readers.TRUTH_SCHEMA).collect()}
    assert len(rows) == 48
    true = {r.source1_entity_id: r.matched_entity_ids for r in readers.read_tsv(spark, f"{folder}/test_ground_truth.tsv", readers.TRUTH_SCHEMA).collect()}
    assert sum(rows[e] == true[e] for e in true) >= 30
    assert len([f for f in (tmp_path / "out" / "matching_results.tsv").iterdir() if f.name.startswith("part-")]) == 1
    assert cli.main(["predict", "--test-dir", str(folder), "--model", model, "--out", f"{out}-parts", "--generation", "1", "--parts"]) == 0
    for name, schema in (("matching_results", readers.TRUTH_SCHEMA), ("candidate_pairs", readers._text("source1_entity_id", "candidate_entity_ids"))):
        whole, parts = (sorted(readers.read_tsv(spark, f"{o}/{name}.tsv", schema).collect()) for o in (out, f"{out}-parts"))
        assert whole == parts and len(whole) == 48
    with pytest.raises(ValueError, match="other features"):
        cli.main(["predict", "--test-dir", str(folder), "--model", model, "--out", out])

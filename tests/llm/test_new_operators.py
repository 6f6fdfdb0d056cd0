"""Conversation trie, hard negatives and the quality classifier: SQL, brute force, awkward rows, held-out accuracy."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinmesh.llm import classifier, negatives, trie
from tests.conftest import duck, same_rows

SF = "/root/testdata/sf0.001"
CLASHES = ("pos", "key", "words", "rep", "m", "len", "top", "_km_value", "_km_part", "r", "v", "near", "far", "query", "score", "held_out", "predicted", "counts", "n")


def clash(df):
    return df.withColumns({c: F.lit("old") for c in CLASHES})


def brute_trie(rows, rebuild):
    """rows: (conv_id, turn, role, text). Nodes as dict (conv_id, depth) -> the other columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    for c in own:
        own[c] = [(r, t) for *_, r, _, t in sorted(own[c])]
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        parent = min(nodes[path[:-1]]) if path else None
        out[min(members), len(path)] = (parent, len(members), kids(path), sum(not kids(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def got_trie(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows) and tuple(df.columns) == trie.COLUMNS
    return out


def conversations():
    """Long shared beginnings, one conversation within another, copies, ties, nulls, repeated rows, hosts that are missing or short."""
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} of all") for c in range(300, 312) for t in range(30)]
    rows += [(300, 30, "user", "one more"), (301, 30, "user", "another"), (302, 30, "user", "another"), (302, 31, "bot", "end")]
    rows += [(c, t, "user", f"text {t if t < c - 400 else 'other'} x") for c in range(400, 408) for t in range(9)]
    rows += [(5, None, None, "no number"), (5, 2, "user", None), (5, 2, "bot", "tie"), (5, 2, "bot", "tie"), (5, 1, "", "")]
    rows += [(None, 1, "user", "nobody's"), (20, 0, "user", "host"), *[(c, 0, "user", "only turn") for c in range(21, 40)], (1007, 3, "user", "no host"), (-3, 1, "user", "below zero")]
    rows += [(700 + k, 0, "user", "copy") for k in range(0, 600)]
    return rows + [(50, 0, "user", " ".join(f"w{i}" for i in range(50_000)))]


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_against_brute_force(spark, monkeypatch, rebuild):
    rows = conversations()
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    plain = lambda: trie.conversation_trie(df) if not rebuild else trie.prefix_trie(*trie.rebuilt(trie.numbered(df)))
    got = got_trie(plain())
    assert got == brute_trie(rows, rebuild)
    if rebuild:
        monkeypatch.setattr(trie, "BROADCAST_CLASSES", -1)
        assert got_trie(plain()) == got


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).isEmpty()
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).isEmpty()
    for rows in ([(8, 1, "u", "a b"), (8, 2, "u", "c")], [(8, 1, "u", "a b"), (9, 1, "u", "a b")]):
        assert got_trie(trie.conversation_trie(spark.createDataFrame(rows, schema))) == brute_trie(rows, False)


def test_trie_against_sql(spark):
    same_rows(trie.op11(spark, SF), duck(SF), trie.oracle())


def brute_negatives(rows, every=100):
    """rows: (vec_id, embedding, label)."""
    first = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [int(np.floor(float(x) * 256)) for x in v])
        first[i] = min(first.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (label, v) in first.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, m) for i, (m, w) in first.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            good = [(-t, i) for t, i, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out |= {(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(good)}
    return out


def vector_rows(n=700):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.3 * rng.normal(size=12)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[100][1], i % 4) for i in range(250)]
    rows += [(2000, None, 1), (None, rows[0][1], 1), (2001, rows[1][1], None), (2002, [None] * 12, 1), (2003, [float("nan")] * 12, 1), (2004, [float("inf")] * 12, 2)]
    rows += [(2100, [0.0] * 12, 1), (2200, [1.0, 2.0], 3), (2300, [], 0), rows[5], rows[5], (6, rows[7][1], 3)]
    return rows


def test_negatives_against_brute_force(spark, monkeypatch):
    rows = vector_rows()
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5))
    take = lambda: {tuple(r) for r in negatives.hard_negatives(df).collect()}
    want = brute_negatives(rows)
    assert len(want) > 150 and take() == want
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "GROUP", 16)
    assert take() == want
    assert negatives.hard_negatives(df.limit(0)).isEmpty() and negatives.hard_negatives(df.filter("vec_id = 100")).isEmpty()


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(1 + (i * 37) % 101 + i), 250_000.0 - i], i % 2) for i in range(1, 60)] + [(100, [3.0, 260_000.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in negatives.hard_negatives(df).collect()} == brute_negatives(rows)
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e12], 1)], df.schema))


def test_brackets_hold_and_skip():
    """Every score lies in its bracket, and clustered vectors are mostly skipped."""
    rng = np.random.default_rng(3)
    centres, which = rng.normal(size=(8, 16)), rng.integers(0, 8, 6000)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.floor(256 * (centres[which] + 0.02 * rng.normal(size=(6000, 16)))).astype(np.int64)
    space = negatives.Space(16, float(np.abs(v).max()), float((v * v).sum(1).max()))
    x = space.augmented(v)
    space.pivots = x[[np.flatnonzero(which == k)[0] for k in range(8)]]
    d = space.distances(x)
    order = np.lexsort((d.min(1), d.argmin(1)))
    v, d = v[order], d[order]
    anchors = negatives.Anchors(np.arange(0, 6000, 100), np.zeros(60, np.int64), v[::100], space)
    low, high = negatives._brackets(anchors, space, d, d, np.arange(60))
    score = space.scores(anchors.v, v)
    assert (low <= score).all() and (score <= high).all()
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(np.zeros(6000, np.int64)), pa.array(v.tolist()), pa.array(d.tolist())], ["vec_id", "label", "v", "far"])
    count = {}
    best = negatives.search(anchors, space, iter([batch]), count)
    assert len(best.id) == 300 and count["scored"] < count["pairs"] / 3


def test_negatives_against_sql(spark):
    same_rows(negatives.op12(spark, SF), duck(SF), negatives.oracle())


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in classifier.op13(spark, sf).collect()}
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(known) > 500
    good, bad = ([r.predicted for r, q in known if q == side] for side in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_classifier_ignores_what_it_must(spark):
    """Held-out labels change nothing, nor do other columns."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    take = lambda d, x: sorted((r.doc_id, round(r.score, 9)) for r in classifier.quality_scores(d, x).collect())
    before = take(documents, labels)
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert take(clash(documents.withColumns({"lang": F.lit("x"), "source": F.lit("y")})), turned) == before


def test_classifier_rows(spark):
    long = " ".join(f"word{i}" for i in range(80_000))
    rows = [(1, "a good text stands here"), (2, None), (3, ""), (4, long), (5, "bad bad bad bad"), (5, "another text"), (None, "no id"), (7, " \n"), (8, "x" * 700_000)]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = clash(spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (4, None), (99, 1), (2, 1)], "doc_id long, quality int"))
    got = classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert {r.predicted for r in classifier.quality_scores(docs, labels.limit(0)).collect()} == {1}
    assert classifier.quality_scores(docs.limit(0), labels).isEmpty()
    assert len({round(r.score, 9) for r in got if r.doc_id in (3, 7)}) == 1


def test_long_texts_are_counted_in_pieces():
    texts = ["one two two", " ".join(f"w{i % 977}" for i in range(200_000)), "", "x" * 900_000, None, "last one"]
    blocks = list(classifier.documents_of(pa.array(texts)))
    counts = np.concatenate([c for _, c in blocks])
    assert [f for f, _ in blocks] == sorted(f for f, _ in blocks) and len(counts) == len(texts)
    assert counts[:, : classifier.WORD_BUCKETS].sum(1).tolist()[:3] == [3, 200_000, 0] and counts[0, -1] == 1
    for k in (0, 5):
        alone = next(iter(classifier.documents_of(pa.array([texts[k]]))))[1]
        assert (alone[0] == counts[k]).all()

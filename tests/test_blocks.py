import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinmesh.operators import blocks, tfidf
from kinmesh.plans import queries as plans


def test_side():
    assert blocks.side(0, 8) == blocks.side(1e6, 8) == blocks.LEAST_ROWS
    for cells, cores in ((1e9, 8), (1e12, 1000), (1e14, 1000)):
        rows = blocks.side(cells, cores)
        assert blocks.TASKS * cores * 0.99 <= cells / rows**2 <= blocks.TASKS * cores


def _met(a, b):
    """Every two blocks once, with what they hold."""
    ids = lambda t: ",".join(sorted(t["id"].to_pylist()))
    return pa.table({"g": a["g"].slice(0, 1), "n": pa.array([a.num_rows]), "m": pa.array([b.num_rows]), "left": [ids(a)], "right": [ids(b)]})


def test_meet_deals_by_counts(spark, monkeypatch):
    """One group with nearly all records: many blocks, each two of which meet once; every two records of a group meet, and no others."""
    rows = [(f"a{i}", "hot") for i in range(400)] + [("b0", "cold"), ("b1", "lone left"), ("b2", None)]
    left = spark.createDataFrame(rows, "id string, g string")
    right = spark.createDataFrame([(f"r{i}", "hot") for i in range(300)] + [("s0", "cold"), ("s1", "lone right"), ("s2", None)], "id string, g string")
    schema = "g string, n long, m long, left string, right string"
    pairs = lambda got: [(x, y) for r in got for x in r["left"].split(",") for y in r["right"].split(",")]
    expected = {(f"a{i}", f"r{j}") for i in range(400) for j in range(300)} | {("b0", "s0")}
    whole = blocks.meet(left, right, "g", _met, schema).collect()
    assert len(whole) == 2
    monkeypatch.setattr(blocks, "LEAST_ROWS", 10)
    for most, groups in ((1000, blocks.BROADCAST_GROUPS), (25, blocks.BROADCAST_GROUPS), (1000, 0)):
        monkeypatch.setattr(blocks, "BROADCAST_GROUPS", groups)
        got = blocks.meet(left, right, "g", _met, schema, left_rows=most, right_rows=most).collect()
        found = pairs(got)
        assert len(found) == len(expected) and set(found) == expected
        hot = [r for r in got if r["g"] == "hot"]
        side = min(most, blocks.side(400 * 300 + 1, spark.sparkContext.defaultParallelism))
        assert len(hot) == -(-400 // side) * -(-300 // side) >= blocks.TASKS * spark.sparkContext.defaultParallelism
        assert max(r["n"] * r["m"] for r in hot) < 4 * np.mean([r["n"] * r["m"] for r in hot])
    none = left.limit(0)
    assert blocks.meet(none, right, "g", _met, schema).isEmpty() and blocks.meet(left, right.filter(F.col("g") == "lone right"), "g", _met, schema).isEmpty()


def test_terms_are_looked_up_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    ends = lambda n: np.concatenate([[0], np.cumsum(rng.integers(0, 6, n))])
    (a, b), whole = (ends(50), ends(40)), blocks.Postings._sums
    x, y = rng.integers(0, 30, a[-1]), rng.integers(0, 30, b[-1])
    v, w = rng.random(len(x)), rng.random(len(y))
    dense = np.zeros((50, 30)), np.zeros((40, 30))
    np.add.at(dense[0], (np.repeat(np.arange(50), np.diff(a)), x), v)
    np.add.at(dense[1], (np.repeat(np.arange(40), np.diff(b)), y), w)
    sizes = []

    def noted(self, terms, starts, weights):
        sizes.append(len(starts) - 1)
        return whole(self, terms, starts, weights)

    monkeypatch.setattr(blocks, "SLICE", 7)
    monkeypatch.setattr(blocks.Postings, "_sums", noted)
    got = list(blocks.Postings(y, b, w).sums(x, a, v))
    assert max(sizes) == 7 and [low for low, _ in got] == list(range(0, 50, 7))
    assert np.allclose(np.concatenate([out for _, out in got]), dense[0] @ dense[1].T)


def test_few_blocks_of_the_second_side():
    """where the first side's blocks are bounded, the second's grow, so a query's best and the first side are shuffled a few times only."""
    cells, cores = 618_000 * 1_240_000, 12
    left, right = blocks.shape(cells, cores, 65_536, 524_288)
    assert left == 65_536 and blocks.RIGHT_ROWS < right <= 524_288 and -(-1_240_000 // right) <= 4
    assert cells / left / right >= blocks.TASKS * cores * 0.99
    assert blocks.shape(cells, cores, 32_768, 16_384) == (32_768, 16_384) and blocks.shape(1e6, 8, 32_768, 16_384) == (blocks.LEAST_ROWS,) * 2


def test_best_of_pieces_is_best_of_all(monkeypatch):
    rng = np.random.default_rng(5)
    scores, k = rng.integers(0, 4, (30, 70)), 6
    best, ids = blocks.Best(30, k), rng.permutation(70)
    block = pa.table({"id": [f"{i:02d}" for i in ids]})
    monkeypatch.setattr(blocks, "PIECE", 16)
    first = 0
    for places, piece in blocks.pieces(block):
        assert piece.num_rows <= 16
        for low in (0, 13):
            part = scores[low : low + (13 if low == 0 else 17), first : first + len(places)]
            i, j = np.nonzero(part)
            best.add(low, i, places[j], part[i, j])
        first += len(places)
    got = list(zip(*(x.tolist() for x in best.found()), strict=True))
    expected = [(i, int(ids[j]), int(scores[i, j])) for i in range(30) for j in sorted(range(70), key=lambda j: (-scores[i, j], ids[j]))[:k] if scores[i, j]]
    assert got == expected and [block["id"][int(n)].as_py() for n in blocks.by_id(block)] == sorted(block["id"].to_pylist())


def test_texts_are_shuffled_not_vectors(spark, monkeypatch):
    """what is dealt into blocks is a record's text, and pieces of a pool's block give what whole ones give."""
    rng, seen, meet = np.random.default_rng(6), [], blocks.meet
    words = ["".join(rng.choice(list("abcd"), 5)) for _ in range(30)]
    records = lambda p, n: spark.createDataFrame([(f"{p}{i}", "fr", " ".join(rng.choice(words, 4)) if i else "") for i in range(n)], "entity_id string, country_norm string, combined string")
    s1, pool = records("a", 40), records("b", 90)
    monkeypatch.setattr(blocks, "meet", lambda left, right, *a, **how: seen.append((left.columns, right.columns)) or meet(left, right, *a, **how))
    got = sorted(map(tuple, tfidf.retrieve(s1, pool, "char", k=5, max_df=None).collect()))
    assert seen == [(["id", "country", "texts"],) * 2]
    index = tfidf.fit(pool, max_df=None)
    assert got == sorted(map(tuple, tfidf.query(s1, index, k=5).collect())) and len(got) == 39 * 5
    # Workers read the constant where they are, so the pieces of a block are tried here.
    sent, terms = tfidf._send(index.vocabulary), index.terms
    sides = [pa.table({"id": [r.entity_id for r in df.collect()], "texts": [[r.combined] for r in df.collect()]}) for df in (s1, pool)]
    match = tfidf._best(5, *(tfidf._made(terms, sent, of_pool) for of_pool in (False, True)))
    whole = sorted(zip(*match(*sides).to_pydict().values(), strict=True))
    monkeypatch.setattr(blocks, "PIECE", 7)
    assert sorted(zip(*match(*sides).to_pydict().values(), strict=True)) == whole == [r[:3] for r in got]


def test_first_candidates_shuffle_texts(spark, monkeypatch):
    """no list of terms is dealt into blocks, and the blocks asked for are those of texts."""
    seen, meet = [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda left, right, *a, **how: seen.append((left.dtypes, right.dtypes, how)) or meet(left, right, *a, **how))
    plans.QUERIES["first_candidates"](spark, "/root/testdata/sf0.001")
    (left, right, how), kinds = seen[0], [("id", "string"), ("country", "string"), ("texts", "array<string>")]
    assert len(seen) == 1 and left == right == kinds and how == tfidf.TEXT_ROWS and how["right_rows"] > blocks.RIGHT_ROWS

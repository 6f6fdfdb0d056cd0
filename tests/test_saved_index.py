"""Indexes in a folder: what is saved, appended and read gives what fitting at once gives."""

import dataclasses
import json
import re

import pytest

from kinmesh.operators import saved_index, tfidf
from kinmesh.plans import fixtures as fx
from kinmesh.sources import writers

COLUMNS = "entity_id string, combined string, name_clean string, country_norm string"


@pytest.fixture(scope="module")
def sides(spark):
    rows = [(f"S{1 + i % 3}-{i:06}", f"name{i % 7} word{i % 11} of{i % 5}", f"n{i % 13} m{i % 4}", "fr" if i % 4 else "en") for i in range(120)]
    rows += [("S1-000900", "name1 more", "n1", ""), ("S2-000900", "name1 less", "n1", ""), ("S2-000777", "", None, "en"), ("S2-000778", None, None, None), (None, "name2", "n2", "fr"), ("S3-000001", "name3 word1", "n3", None)]
    records = spark.createDataFrame(rows, COLUMNS)
    return fx.first_source(records), records.filter("entity_id IS NULL OR entity_id NOT LIKE 'S1-%'")


def _found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("text", "terms", "max_features"), [("combined", tfidf.char_terms, 200_000), ("combined", tfidf.word_terms, None), ("name_clean", tfidf.char_terms, 40)])
def test_round_trip_and_append(spark, sides, tmp_path, text, terms, max_features):
    """Equal to an index with the old vocabulary over all records; a repeated append, and one of records that are there, changes nothing."""
    s1, pool = sides
    old, new = pool.filter("entity_id LIKE 'S2-%'"), pool.filter("entity_id IS NULL OR entity_id NOT LIKE 'S2-%'")
    path = f"file://{tmp_path}/index"
    fitted = tfidf.fit(old, text=text, terms=terms, max_df=None, max_features=max_features)
    saved_index.save(fitted, path)
    assert _found(saved_index.query(s1, path, k=5)) == _found(tfidf.query(s1, fitted, k=5)) != []
    vectors = tfidf._pool(tfidf._texts(pool, text), terms, fitted.vocabulary, fitted.few)
    expected = _found(tfidf.query(s1, dataclasses.replace(fitted, vectors=vectors), k=5))
    saved_index.append(new, path)
    saved_index.append(pool, path)
    saved_index.append(new.limit(0), path, segment="batch-1")
    assert _found(saved_index.query(s1, path, k=5, left_rows=9, right_rows=4)) == expected
    whole = f"file://{tmp_path}/whole"
    saved_index.save(saved_index.load(spark, path), whole)
    assert len(writers.segments(spark, f"{whole}/segments")) == 1
    assert _found(saved_index.query(s1, whole, k=5)) == expected


def test_segment_by_name_is_replaced(spark, sides, tmp_path):
    _, pool = sides
    path = f"file://{tmp_path}/index"
    saved_index.save(tfidf.fit(pool.limit(0), max_df=None), path)
    assert saved_index.load(spark, path).vectors.count() == 0
    path = f"file://{tmp_path}/other"
    saved_index.save(tfidf.fit(pool.filter("entity_id LIKE 'S2-%'"), max_df=None), path)
    before = saved_index.load(spark, path).vectors.count()
    for ids in (["S3-000002", "S3-000005"], ["S3-000008"]):
        saved_index.append(pool.filter(pool.entity_id.isin(ids)), path, segment="batch-0")
        assert saved_index.load(spark, path).vectors.count() == before + len(ids)


def test_unfinished_segments_and_other_versions(spark, sides, tmp_path):
    s1, pool = sides
    path = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="no finished index"):
        saved_index.load(spark, path)
    with pytest.raises(ValueError, match="can be saved"):
        saved_index.save(tfidf.fit(pool, terms=str.split), path)
    index = tfidf.fit(pool, max_df=None)
    saved_index.save(index, path)
    with pytest.raises(ValueError, match="there is an index"):
        saved_index.save(index, path)
    expected = _found(saved_index.query(s1, path, k=5))
    # A lost run's segment: rows, but no mark that it is finished.
    saved_index.append(spark.createDataFrame([("S3-999999", "name1 word1 of1", "n1", "fr")], COLUMNS), path, segment="lost")
    assert _found(saved_index.query(s1, path, k=5)) != expected
    (tmp_path / "index/segments/lost/_SUCCESS").unlink()
    assert _found(saved_index.query(s1, path, k=5)) == expected
    side = json.loads(spark.read.text(f"{path}/sidecar").first()["value"])
    for change in ({"layout": 0}, {"preprocess_version": -1}):
        spark.createDataFrame([(json.dumps(side | change),)], "value string").write.mode("overwrite").text(f"{path}/sidecar")
        with pytest.raises(ValueError, match="the index expects"):
            saved_index.load(spark, path)


def test_only_asked_countries_are_read(spark, sides, tmp_path, monkeypatch):
    s1, pool = sides
    path, seen = f"file://{tmp_path}/index", []
    saved_index.save(tfidf.fit(pool, max_df=None), path)
    inner = tfidf.query
    monkeypatch.setattr(tfidf, "query", lambda s1, index, **how: seen.append(index.vectors) or inner(s1, index, **how))
    some = saved_index.query(s1.filter("country_norm = 'en'"), path, k=5)
    assert re.search(r"PushedFilters: \[.*(EqualTo\(country,en\)|In\(country, \[en\]\))", seen[0]._jdf.queryExecution().toString())
    assert _found(some) == [r for r in _found(saved_index.query(s1, path, k=5)) if r[0] in {x.entity_id for x in s1.filter("country_norm = 'en'").collect()}]
    monkeypatch.setattr(saved_index, "NAMED_GROUPS", 0)
    assert _found(saved_index.query(s1.filter("country_norm = 'en'"), path, k=5)) == _found(some)

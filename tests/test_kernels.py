"""String kernels against hand-worked values, brute force and their properties."""

from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinmesh.functions import batch
from kinmesh.functions import kernels as k

text = st.text("abc ", max_size=9)


def lcs(a, b):
    @cache
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_known_values():
    assert k.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert k.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)
    assert k.jaro_winkler("abcdefgh", "abxyzwvu") == pytest.approx(0.5)
    assert k.token_sort("b a", "a b") == 1 and k.token_set("a b", "a") == 1 and k.token_set("", "a") == 0
    assert k.partial("bcd", "abcde") == 1 and k.ratio("", "") == 1 and k.ratio("ab", "ac") == 0.5
    assert k.soundex("Robert") == "R163" and k.soundex("Tymczak") == "T522" and k.soundex("") == ""
    assert k.metaphone("Thompson")[:2] in ("TM", "0M") and k.metaphone("knight")[0] == "N" and k.metaphone("Xavier")[0] == "S"
    assert k.nysiis("Knight")[0] == "N" and k.nysiis("MacDonald").startswith("MC")
    assert k.sequence_ratio("", "") == 1 and k.sequence_ratio("", "a") == 0 and k.sequence_ratio("abcd", "bcde") == 0.75


@settings(max_examples=200, deadline=None)
@given(text, text)
def test_properties(a, b):
    assert k.common_subsequence(a, b) == lcs(a, b)
    for f in (k.jaro_winkler, k.ratio, k.token_sort, k.token_set, k.partial):
        assert 0 <= f(a, b) <= 1 and f(a, b) == pytest.approx(f(b, a))
        if a.split():
            assert f(a, a) == pytest.approx(1)
    assert k.partial(a, b) >= k.ratio(a, b) - 1e-12 or len(a) != len(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(text, st.one_of(text, st.text("abc éж𝔘", max_size=70))), max_size=40))
def test_batches_equal_single_pairs(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    for name in ("jaro_winkler", "ratio", "token_sort", "token_set", "partial"):
        assert list(getattr(batch, name)(left, right)) == [getattr(k, name)(a, b) for a, b in pairs], name


def test_batches_of_long_and_repeated_pairs(monkeypatch):
    words = ["".join(chr(97 + (i * j) % 17) for j in range(1 + i % 11)) for i in range(1, 60)]
    texts = [" ".join(words[i : i + 1 + i % 20]) for i in range(40)] + ["", "x" * 700, "x" * 699 + "y", "ab" * 40, "".join(map(chr, range(256, 600)))]
    pairs = [(a, b) for a in texts[::3] for b in texts[::4]] * 2
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    for cells, masks in ((batch.CELLS, batch.MASKS), (64, 256)):
        monkeypatch.setattr(batch, "CELLS", cells)
        monkeypatch.setattr(batch, "MASKS", masks)
        for name in ("jaro_winkler", "ratio", "token_sort", "token_set"):
            assert list(getattr(batch, name)(left, right)) == [getattr(k, name)(a, b) for a, b in pairs], name
    short = [(a, b) for a, b in pairs if len(a) + len(b) < 200][:60]
    assert list(batch.partial([a for a, _ in short], [b for _, b in short])) == [k.partial(a, b) for a, b in short]


def test_edit_similarity_equals_brute_force():
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = ["", "a", "abc 𝔘", "ab" * 33, "cab " * 16, "abcé" * 30, "x" * 300, "xa" * 140]
    pairs = [(a, b) for a in words for b in words]
    expected = [1 - lev(a, b) / max(len(a), len(b)) if a or b else 1.0 for a, b in pairs]
    assert batch.edit_similarity(*map(list, zip(*pairs, strict=True))).tolist() == expected
    assert [k.distance(a, b) for a, b in pairs] == [lev(a, b) for a, b in pairs]

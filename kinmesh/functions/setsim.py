"""Similarities of token sets and lengths as Column expressions; two empty sides are alike unless said otherwise."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(over: Column, under: Column) -> Column:
    return over.cast("double") / under


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


class Sets(NamedTuple):
    """Sizes of two sets and of what they share."""

    a: Column
    b: Column
    both: Column

    def swapped(self) -> Sets:
        return Sets(self.b, self.a, self.both)


def sets(a: Column, b: Column) -> Sets:
    """Of two array columns without repeats."""
    return Sets(F.size(a), F.size(b), common(a, b))


def jaccard(s: Sets) -> Column:
    return F.when((s.a == 0) & (s.b == 0), 1.0).when((s.a == 0) | (s.b == 0), 0.0).otherwise(_ratio(s.both, s.a + s.b - s.both))


def overlap(s: Sets) -> Column:
    """Any empty side gives 0."""
    least = F.least(s.a, s.b)
    return F.when(least == 0, 0.0).otherwise(_ratio(s.both, least))


def dice(s: Sets) -> Column:
    total = s.a + s.b
    return F.when(total == 0, 1.0).otherwise(_ratio(2 * s.both, total))


def containment(s: Sets) -> Column:
    """Share of the first that the second holds; 0 for an empty first."""
    return F.when(s.a == 0, 0.0).otherwise(_ratio(s.both, s.a))


def number_match(s: Sets) -> Column:
    return F.when(s.a > 0, _ratio(s.both, s.a)).when(s.b == 0, 1.0).otherwise(0.5)


def either_empty(a: Column, b: Column, otherwise: Column) -> Column:
    """1 for two empty texts, 0 for one, else the given value."""
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(otherwise)


def length_ratio(a: Column, b: Column) -> Column:
    return either_empty(a, b, _ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))))


def contained(a: Column, b: Column) -> Column:
    """Length ratio if one text holds the other, else 0."""
    inside = F.contains(b, a) | F.contains(a, b)
    return either_empty(a, b, F.when(inside, _ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))).otherwise(0.0))


def char_grams(text: Column, n: int = 3) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

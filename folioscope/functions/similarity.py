"""Similarities of two texts or two token arrays, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import compact, fold, let


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Banded test: the native distance stops beyond ``k``."""
    return F.levenshtein(a, b, k) >= 0


def bigrams(c: Column) -> Column:
    pairs = lambda t: F.when(F.length(t) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return let(F.regexp_replace(F.lower(c), r"\s+", ""), pairs)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the different character bigrams."""
    of = lambda x, y: F.when(F.size(x) + F.size(y) > 0, 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))
    return let(bigrams(a), lambda x: let(bigrams(b), lambda y: of(x, y)))


def jaccard(x: Column, y: Column, digits: int = 3) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.round(F.size(F.array_intersect(x, y)) / union, digits)).otherwise(F.lit(0.0))


def containment(x: Column, y: Column) -> Column:
    """Share of ``y`` that is in ``x``."""
    return F.when(F.size(y) > 0, F.size(F.array_intersect(x, y)) / F.size(y)).otherwise(F.lit(0.0))


def overlap(x: Column, y: Column) -> Column:
    """Share of the smaller set that is in the other."""
    n = F.least(F.size(x), F.size(y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def length_similarity(a: Column, b: Column, low: float = 0.45, high: float = 2.4) -> Column:
    x, y = F.length(compact(a)), F.length(compact(b))
    r = y / x
    return F.when((x == 0) | (y == 0), F.lit(0.0)).when((r < low) | (r > high), F.lit(0.0)).otherwise(F.least(r, 1 / r))


def length_ratio(a: Column, b: Column, if_empty: float = 1.0) -> Column:
    """Length of ``b`` over that of ``a``; callers differ in what an empty side means."""
    x, y = F.length(compact(a)), F.length(compact(b))
    return F.when((x == 0) | (y == 0), F.lit(if_empty)).otherwise(y / x)


def said_twice(parts: Column) -> Column:
    """Of an array of sentences (a column), the first of 19 characters or more that is followed by itself; null if none."""
    pairs = F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.size(parts) - 2))
    again = F.filter(pairs, lambda i: (F.length(F.get(parts, i)) > 18) & (F.lower(F.get(parts, i)) == F.lower(F.get(parts, i + 1))))
    return F.get(parts, F.try_element_at(again, F.lit(1)))


def repeated_run(words: Column, least: int = 5, most: int = 9) -> Column:
    """A run of 5 to 9 words that repeats at once; null if none. ``words`` must be a column, not an expression: it is read at every place."""

    def run_of(n: int) -> Column:
        # Places are compared one by one (a slice would copy the whole array at every place).
        starts = F.when(F.size(words) >= 2 * n, F.sequence(F.lit(0), F.size(words) - 2 * n))
        again = F.filter(starts, lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == F.get(words, i + n + k) for k in range(n))))
        return F.array_join(F.slice(words, F.try_element_at(again, F.lit(1)) + 1, F.lit(n)), " ")

    return F.coalesce(*(run_of(n) for n in range(least, most + 1)))


def closest_distance(words: Column, left: Column, right: Column) -> Column:
    """Least number of words between any of ``left`` and any of ``right``; null if one side is absent."""
    folded = F.transform(words, lambda w: fold(w))
    at = lambda wanted: F.filter(F.transform(folded, lambda w, i: F.when(F.array_contains(wanted, w), i)), lambda i: i.isNotNull())
    return F.array_min(F.flatten(F.transform(at(left), lambda x: F.transform(at(right), lambda y: F.abs(x - y)))))

"""Set and number similarities of two arrays or strings, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinspark.functions import tables


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint members of two arrays without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))


def flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def equal(a: Column, b: Column) -> Column:
    """1 where equal and not empty."""
    return flag((a == b) & (a != ""))


def one_sided(a: Column, b: Column) -> Column:
    return flag((a == "") != (b == ""))


def subsequence(longer: Column, shorter: Column) -> Column:
    """Whether the digits of one occur in order in the other; for strings of digits only."""
    return F.rlike(longer, F.array_join(F.split(shorter, ""), ".*"))


def digits_drop(a: Column, b: Column) -> Column:
    """Whether one number is the other with at most two digits left out."""
    la, lb = F.length(a), F.length(b)
    longer, shorter = F.when(la >= lb, a).otherwise(b), F.when(la >= lb, b).otherwise(a)
    return (F.abs(la - lb) <= 2) & (F.least(la, lb) > 0) & subsequence(longer, shorter)


def without_zeros(numbers: Column) -> Column:
    """Numbers without leading zeros ("0" if nothing else), distinct."""
    return F.array_distinct(F.transform(numbers, lambda d: F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0"))))


def near_numbers(a: Column, b: Column) -> Column:
    """Share of all numbers that are in ``a`` alone and at one edit from one in ``b`` alone."""
    only_a, only_b = F.array_except(a, b), F.array_except(b, a)
    near = F.filter(only_a, lambda x: F.exists(only_b, lambda y: (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(x, y) <= 1)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(near) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def compatible_numbers(a: Column, b: Column) -> Column:
    """Numbers of ``a`` that equal one of ``b`` or differ by dropped digits, over the size of the smaller set; may exceed 1."""
    met = F.filter(a, lambda x: F.array_contains(b, x) | F.exists(b, lambda y: digits_drop(x, y)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(met) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))


def house_number(words: Column) -> Column:
    """The first token of digits only, or the empty string."""
    return F.coalesce(F.try_element_at(F.filter(words, lambda t: t.rlike("^[0-9]+$")), F.lit(1)), F.lit(""))


def ordinals(words: Column) -> Column:
    """Spelled or suffixed ordinals as digits, distinct."""
    pairs = F.create_map(*(F.lit(x) for kv in tables.ORDINALS.items() for x in kv))
    one = lambda t: F.coalesce(F.element_at(pairs, t), F.nullif(F.regexp_extract(t, "^([0-9]+)(st|nd|rd|th)$", 1), F.lit("")))
    return F.array_distinct(F.filter(F.transform(words, one), lambda x: x.isNotNull()))


def prefix_overlap(a: Column, b: Column) -> Column:
    """Share of all tokens that are in ``a`` alone and begin, or are begun by, one in ``b`` alone (the shorter of 3 or more)."""
    only_a, only_b = F.array_except(a, b), F.array_except(b, a)
    pair = lambda x, y: (F.least(F.length(x), F.length(y)) >= 3) & (x.startswith(y) | y.startswith(x))
    met = F.filter(only_a, lambda x: F.exists(only_b, lambda y: pair(x, y)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(met) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def mass(words: Column, idf, default: float) -> Column:
    """Sum of idf over tokens; ``idf``: maps of the tokens that are known, asked in turn."""
    return F.aggregate(words, F.lit(0.0), lambda acc, t: acc + F.coalesce(*(F.element_at(m, t) for m in idf), F.lit(default)))


def idf_overlap(a: Column, b: Column, idf, default: float = 8.0) -> Column:
    joint = mass(F.array_union(a, b), idf, default)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (joint == 0), 0.0).otherwise(mass(F.array_intersect(a, b), idf, default) / joint)


def idf_containment(a: Column, b: Column, idf, default: float = 12.0) -> Column:
    least = F.least(mass(a, idf, default), mass(b, idf, default))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (least <= 0), 0.0).otherwise(mass(F.array_intersect(a, b), idf, default) / least)

"""Set values: arrays without repeats, sorted, in which null is an element like any other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(a: Column) -> Column:
    """Distinct elements in order, null first."""
    d = F.array_distinct(a)
    return F.concat(F.filter(d, lambda x: x.isNull()), F.array_sort(F.filter(d, lambda x: x.isNotNull())))


def union(a: Column, b: Column) -> Column:
    return make(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return make(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return make(F.array_except(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    return make(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_strict_subset(a: Column, b: Column) -> Column:
    return is_subset(a, b) & ~is_subset(b, a)


def is_superset(a: Column, b: Column) -> Column:
    return is_subset(b, a)


def is_strict_superset(a: Column, b: Column) -> Column:
    return is_strict_subset(b, a)


def intersects(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def equals(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def insert(a: Column, v: Column) -> Column:
    return make(F.array_union(a, F.array(v)))


def erase(a: Column, v: Column) -> Column:
    return make(F.array_except(a, F.array(v)))

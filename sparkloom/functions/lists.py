"""List and dictionary values: edits by position or key, sorting and distinct elements.

Positions count from 0. An edit outside of a list is an error of the job that runs it; edits of a null list are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.tree import QueryError


def get(a: Column, i: int | Column) -> Column:
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def find(a: Column, v) -> Column:
    """Position of the first element that equals ``v``, or -1."""
    v = v if isinstance(v, Column) else F.lit(v)
    hit = F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(v), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(-1))


def _inside(a: Column, positions: tuple[int, ...], room: int, out: Column) -> Column:
    """``out``, or an error where one of the positions is beyond the list's length plus ``room``."""
    for i in positions:
        if i < 0:
            raise QueryError("A position isn't negative")
    message = F.concat(F.lit(f"Position {max(positions)} is outside of a list of "), F.size(a).cast("string"))
    return F.when(F.size(a) + room > max(positions), out).when(a.isNotNull(), F.raise_error(message))


def insert(a: Column, i: int, v) -> Column:
    v = v if isinstance(v, Column) else F.lit(v)
    return _inside(a, (i,), 1, F.concat(F.slice(a, 1, i) if i else F.slice(a, 1, 0), F.array(v), F.slice(a, F.lit(i + 1), F.greatest(F.size(a) - i, F.lit(0)))))


def remove(a: Column, i: int) -> Column:
    return _inside(a, (i,), 0, F.concat(F.slice(a, 1, i), F.slice(a, F.lit(i + 2), F.greatest(F.size(a) - i - 1, F.lit(0)))))


def put_at(a: Column, i: int, v) -> Column:
    """The element at ``i`` replaced."""
    v = v if isinstance(v, Column) else F.lit(v)
    return _inside(a, (i,), 0, F.transform(a, lambda x, k: F.when(k == i, v).otherwise(x)))


def move(a: Column, i: int, j: int) -> Column:
    """Take the element at ``i`` and put it back so that it is at ``j``."""
    return _inside(a, (i, j), 0, insert(remove(a, i), j, F.get(a, F.lit(i))))


def swap(a: Column, i: int, j: int) -> Column:
    return _inside(a, (i, j), 0, F.transform(a, lambda x, k: F.when(k == i, F.get(a, F.lit(j))).when(k == j, F.get(a, F.lit(i))).otherwise(x)))


def resize(a: Column, n: int) -> Column:
    """Cut to ``n`` elements, or filled up with null."""
    return F.concat(F.slice(a, 1, n), F.transform(F.slice(F.array_repeat(F.lit(0), n), F.lit(1), F.greatest(F.lit(n) - F.size(a), F.lit(0))), lambda _: F.get(a, F.lit(-1))))


def ordered(a: Column, ascending: bool = True) -> Column:
    """Sorted, null first when ascending."""
    return F.sort_array(a, ascending)


def distinct(a: Column) -> Column:
    return F.array_distinct(a)


def sorted_positions(a: Column, ascending: bool = True) -> Column:
    """Positions in the order of their elements, null first when ascending, equal ones as they stand."""
    at = F.transform(a, lambda x, i: F.struct(x.alias("x"), (i if ascending else -i).alias("i")))
    return F.transform(F.sort_array(at, ascending), lambda s: s["i"] if ascending else -s["i"])


def distinct_positions(a: Column) -> Column:
    """Positions of the first of each group of equal elements."""
    return F.filter(F.transform(a, lambda x, i: F.when(~F.exists(F.slice(a, F.lit(1), i), lambda y: y.eqNullSafe(x)), i)), lambda i: i.isNotNull())


def put(m: Column, key: str, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), v))


def erase(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def sorted_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))

"""Lists, sets and dictionaries of an object as facades: reads are frames or values, edits are new versions of the class's frame.

A facade stands for one property of one object. Its edits are column functions behind a test for the object's key, so an edit is
one pass over the class; positions out of bounds are errors of the running job, as the length is only known there.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists, sets, values
from ..plans.catalog import Catalog, Property
from ..plans.lower import q
from ..plans.tree import QueryError
from .results import Results


class Collection:
    """What the three kinds share."""

    def __init__(self, catalog: Catalog, cls: str, key: Any, prop: str):
        self.catalog, self.cls, self.key = catalog, catalog.get(cls), key
        if not self.cls.key:
            raise QueryError(f"'{cls}' has no key, so none of its objects can be named")
        self.prop: Property = self.cls.find(prop)
        self.kind = self.cls.kinds[self.prop.col]
        self.column = q(self.prop.col)

    # -- reads

    def _mine(self) -> DataFrame:
        return self.cls.frame.where(q(self.cls.key) == F.lit(self.key))

    def _elements(self) -> Column:
        return self.column

    @property
    def element(self) -> str:
        return self.kind[6:-1]

    def value(self):
        """The whole collection, or None."""
        row = self._mine().select(self.column).head()
        return None if row is None else row[0]

    def _one(self, c: Column):
        row = self._mine().select(c.alias("v")).head()
        return None if row is None else row[0]

    def size(self) -> int:
        return self._one(F.coalesce(F.size(self.column), F.lit(0))) or 0

    def as_results(self) -> DataFrame:
        """(position, value), one row an element."""
        return self._mine().select(F.posexplode(self._elements()).alias("position", "value"))

    def snapshot(self, path: str) -> DataFrame:
        """The elements as they are now, written once."""
        spark = self.catalog.spark
        self.as_results().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def _number(self, fn: str):
        if not values.is_number(self.element) and not (fn in ("min", "max") and self.element.startswith("timestamp")):
            raise QueryError(f"'{fn}' isn't known for a collection of '{self.element}'")
        return self._one(values.array_aggregate(fn, self._elements(), self.element))

    def min(self):
        return self._number("min")

    def max(self):
        return self._number("max")

    def sum(self):
        return self._number("sum")

    def average(self):
        return self._number("avg")

    def sort(self, path: str = "self", ascending: bool = True) -> list:
        """Elements in order; of plain values the only path is ``self``."""
        if path != "self":
            raise QueryError("A collection of plain values is sorted by 'self' only")
        return self._one(lists.ordered(self._elements(), ascending)) or []

    def distinct(self, path: str = "self") -> list:
        """Elements without later repeats, in their order."""
        if path != "self":
            raise QueryError("A collection of plain values is distinct by 'self' only")
        return self._one(lists.distinct(self._elements())) or []

    def sort_indices(self, ascending: bool = True) -> list[int]:
        """Positions in the order of their elements, equal ones as they stand."""
        return self._one(lists.sorted_positions(self._elements(), ascending)) or []

    def distinct_indices(self) -> list[int]:
        """Positions of the first of each group of equal elements."""
        return self._one(lists.distinct_positions(self._elements())) or []

    # -- edits

    def _edit(self, new: Column) -> DataFrame:
        mine = q(self.cls.key) == F.lit(self.key)
        return self.cls.frame.withColumn(self.prop.col, F.when(mine, new.cast(self.kind)).otherwise(self.column))

    def remove_all(self) -> DataFrame:
        return self._edit(F.array() if not self.kind.startswith("map<") else F.create_map())


class List(Collection):
    """A list of values or of links to objects."""

    @property
    def linked(self) -> bool:
        return self.prop.kind == "links"

    def _target(self):
        if not self.linked:
            raise QueryError(f"'{self.prop.name}' holds no objects")
        return self.catalog.get(self.prop.target)

    def objects(self) -> DataFrame:
        """The linked objects with ``position``, in list order, repeats included."""
        target = self._target()
        at = self.as_results()
        return at.join(target.frame, at["value"] == q(target.key)).drop("value").orderBy("position")

    def query(self, text: Any = "TRUEPREDICATE", *args: Any) -> DataFrame:
        """The linked objects that satisfy a predicate with ``position``, in list order: a list as a query's source."""
        target = self._target()
        at = self.as_results()
        return at.join(Results(self.catalog, target.name, text, args=args).df(ordered=False), at["value"] == q(target.key)).drop("value").orderBy("position")

    filter = query

    def get(self, n: int):
        return self._one(lists.get(self.column, n))

    def find(self, v: Any) -> int:
        """Position of the first element that equals ``v``, or -1."""
        return self._one(lists.find(self.column, F.lit(v).cast(self.element)))

    def find_where(self, text: Any, *args: Any) -> int:
        """Position of the first linked object that satisfies a predicate, or -1."""
        row = self.query(text, *args).agg(F.min("position")).head()
        return -1 if row[0] is None else row[0]

    def _lit(self, v: Any) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast(self.element)

    def add(self, v: Any) -> DataFrame:
        return self._edit(F.concat(F.coalesce(self.column, F.array().cast(self.kind)), F.array(self._lit(v))))

    def insert(self, n: int, v: Any) -> DataFrame:
        return self._edit(lists.insert(self.column, n, self._lit(v)))

    def set(self, n: int, v: Any) -> DataFrame:
        return self._edit(lists.put_at(self.column, n, self._lit(v)))

    def move(self, i: int, j: int) -> DataFrame:
        return self._edit(lists.move(self.column, i, j))

    def swap(self, i: int, j: int) -> DataFrame:
        return self._edit(lists.swap(self.column, i, j))

    def remove(self, n: int) -> DataFrame:
        return self._edit(lists.remove(self.column, n))

    def assign(self, vs: Any) -> DataFrame:
        return self._edit(F.array(*map(self._lit, vs)))

    def delete_at(self, n: int) -> dict[str, DataFrame]:
        """The class without the object that the list holds there, and every class that loses a link by that."""
        return self._deleted(lists.get(self.column, n))

    def delete_all(self) -> dict[str, DataFrame]:
        return self._deleted(None)

    def _deleted(self, one: Column | None) -> dict[str, DataFrame]:
        from .edits import cascade

        target = self._target()
        gone = self._mine().select(F.explode(F.array(one) if one is not None else self.column).alias("__gone")).distinct()
        return cascade(self.catalog, target.name, target.frame.join(gone, q(target.key) == q("__gone"), "left_anti"))

    def add_embedded(self, frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(own class, embedded class) with the one new object of ``frame`` at the list's end."""
        target = self._target()
        if not target.embedded:
            raise QueryError(f"'{target.name}' isn't embedded")
        key = frame.select(target.key).head()[0]
        return self.add(key), target.frame.unionByName(frame, allowMissingColumns=True)


class Set(Collection):
    """A set of values: sorted, each once, null among them."""

    def _lit(self, v: Any) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast(self.element)

    def _other(self, other: Any) -> Column:
        """Another set: values, or a set of the same class."""
        if isinstance(other, Set):
            return F.lit(None) if (v := other.value()) is None else F.array(*map(self._lit, v)).cast(self.kind)
        return F.array(*map(self._lit, other)).cast(self.kind)

    def find(self, v: Any) -> int:
        return self._one(lists.find(sets.make(self.column), self._lit(v)))

    def insert(self, v: Any) -> DataFrame:
        return self._edit(sets.insert(F.coalesce(self.column, F.array().cast(self.kind)), self._lit(v)))

    def erase(self, v: Any) -> DataFrame:
        return self._edit(sets.erase(self.column, self._lit(v)))

    def assign_union(self, other: Any) -> DataFrame:
        return self._edit(sets.union(self.column, self._other(other)))

    def assign_intersection(self, other: Any) -> DataFrame:
        return self._edit(sets.intersection(self.column, self._other(other)))

    def assign_difference(self, other: Any) -> DataFrame:
        return self._edit(sets.difference(self.column, self._other(other)))

    def assign_symmetric_difference(self, other: Any) -> DataFrame:
        return self._edit(sets.symmetric_difference(self.column, self._other(other)))

    def is_subset_of(self, other: Any) -> bool:
        return self._one(sets.is_subset(self.column, self._other(other)))

    def is_strict_subset_of(self, other: Any) -> bool:
        return self._one(sets.is_strict_subset(self.column, self._other(other)))

    def is_superset_of(self, other: Any) -> bool:
        return self._one(sets.is_superset(self.column, self._other(other)))

    def is_strict_superset_of(self, other: Any) -> bool:
        return self._one(sets.is_strict_superset(self.column, self._other(other)))

    def intersects(self, other: Any) -> bool:
        return self._one(sets.intersects(self.column, self._other(other)))

    def equals(self, other: Any) -> bool:
        return self._one(sets.equals(self.column, self._other(other)))

    def filter(self, test) -> DataFrame:
        """(position, value) of the elements for which ``test``, a function of a Column, holds."""
        return self.as_results().where(test(F.col("value")))


class Dictionary(Collection):
    """Values by string keys."""

    @property
    def element(self) -> str:
        return self.kind[self.kind.index(",") + 1 : -1]

    def _elements(self) -> Column:
        return F.map_values(self.column)

    def get(self, key: str):
        """The value, or None where the key isn't there."""
        return self._one(F.try_element_at(self.column, F.lit(key)))

    def contains(self, key: str) -> bool:
        return bool(self._one(F.map_contains_key(self.column, key)))

    def find_any(self, v: Any) -> str | None:
        """The first key in order whose value equals ``v``."""
        v = F.lit(v).cast(self.element)
        return self._one(F.array_min(F.map_keys(F.map_filter(self.column, lambda _, x: x.eqNullSafe(v)))))

    def keys(self) -> DataFrame:
        """(position, value) of the keys, sorted."""
        return self._mine().select(F.posexplode(lists.sorted_keys(self.column)).alias("position", "value"))

    def values(self) -> DataFrame:
        """(key, value), sorted by key."""
        return self._mine().select(F.explode(self.column)).orderBy("key")

    def insert(self, key: str, v: Any) -> DataFrame:
        v = (v if isinstance(v, Column) else F.lit(v)).cast(self.element)
        return self._edit(lists.put(F.coalesce(self.column, F.create_map().cast(self.kind)), key, v))

    def erase(self, key: str) -> DataFrame:
        return self._edit(lists.erase(self.column, key))

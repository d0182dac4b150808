"""Lazy results of a class: predicate, ordering, aggregates, sections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..plans.catalog import Catalog
from ..plans.lower import Lowering, Scalar, q
from ..plans.parser import Parser, merged, parse
from ..plans.tree import And, Compare, Const, Distinct, Keep, Key, Limit, Or, Path, Query, QueryError, Restrict, Sort, Truth, Within

CUTS = (Distinct, Limit, Keep, Restrict, Within)


class Results:
    """Objects of a class in an order. Nothing runs until a value or a frame is asked for."""

    def __init__(self, catalog: Catalog, cls: str, where: Any = Truth(True), order: Sequence = (), args: Sequence[Any] = ()):
        self.catalog, self.cls = catalog, catalog.get(cls)
        parsed = _query(where, args)
        where, order = parsed.where, (*parsed.order, *order)
        self.where, self.order = where, tuple(merged(list(order)))

    # -- building

    def _with(self, where=None, order=None) -> "Results":
        return Results(self.catalog, self.cls.name, self.where if where is None else where, self.order if order is None else order)

    def filter(self, text: Any, *args: Any) -> "Results":
        """And a predicate into the base one, so before any distinct; not after a limit."""
        if any(isinstance(o, Limit) for o in self.order):
            raise QueryError("Filtering results after a limit isn't known")
        more = _query(text, args)
        return self._with(And((self.where, more.where)), (*self.order, *more.order))

    def sort(self, *keys: str | tuple[str, bool]) -> "Results":
        return self._with(order=(*self.order, Sort(tuple((_path(k if isinstance(k, str) else k[0]), isinstance(k, str) or k[1]) for k in keys))))

    def distinct(self, *paths: str) -> "Results":
        return self._with(order=(*self.order, Distinct(tuple(map(_path, paths)))))

    def limit(self, n: int) -> "Results":
        if n < 0:
            raise QueryError("A limit isn't negative")
        return self._with(order=(*self.order, Limit(n)))

    def keep(self, test: Callable[[DataFrame], Column]) -> "Results":
        """A caller's own test: from the frame so far to a boolean Column, which may be a pandas UDF's."""
        return self._with(order=(*self.order, Keep(test)))

    def query(self, text: Any, *args: Any) -> "Results":
        """A query over these results as a view: its predicate sees what the ordering leaves, limits and distincts included."""
        more = _query(text, args)
        return self._with(order=(*self.order, Restrict(more.where), *more.order)) if self._cut() else self._with(And((self.where, more.where)), (*self.order, *more.order))

    def _cut(self) -> bool:
        return any(isinstance(o, CUTS) for o in self.order)

    def __and__(self, other: "Results") -> "Results":
        """The objects of both, in this one's order."""
        if other._cut():
            return self._with(order=(*self.order, Within((other,))))
        return self.query(other.where)

    def __or__(self, other: "Results") -> "Results":
        """The objects of either, in the order of the class."""
        if self._cut() or other._cut():
            return Results(self.catalog, self.cls.name, order=(Within((self, other)),))
        return Results(self.catalog, self.cls.name, Or((self.where, other.where)))

    def __str__(self) -> str:
        return str(Query(self.where, self.order))

    # -- frames

    def df(self, ordered: bool = True) -> DataFrame:
        """The objects' own columns."""
        low = Lowering(self.catalog, self.cls.name)
        low.filtered(self.where)
        keys = self._fold(low, self.order) if ordered else []
        df = low.root.df
        if keys and any(isinstance(o, Sort) for o in self.order):
            df = df.orderBy(*values.ordered(keys))
        return df.select(*[q(c) for c in self.cls.frame.columns])

    def _fold(self, low: Lowering, order: Sequence) -> list[tuple[Column, bool]]:
        """Apply sorts, distincts, limits and tests in written order. The order so far is kept as sort keys (expression, ascending), so sorting is stable and rows are only sorted where a limit or the end needs it."""
        f = low.root
        keys: list[tuple[Column, bool]] = [(q(c), True) for c in self.cls.order]
        for o in order:
            if isinstance(o, Sort):
                new = []
                for path, asc in o.keys:
                    x = self._single(low, path)
                    if x.via is not None:
                        new.append((x.via.isNull(), asc))
                    new += [(k, asc) for k in values.order_keys(x.col, x.kind)]
                keys = new + keys
            elif isinstance(o, Distinct):
                xs = [self._single(low, p) for p in o.paths]
                for x in xs:
                    if x.via is not None:
                        f.df = f.df.where(x.via.isNotNull())
                w = Window.partitionBy(*[x.col for x in xs]).orderBy(*(values.ordered(keys) or [F.lit(0)]))
                f.df = f.df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
            elif isinstance(o, Limit):
                f.df = (f.df.orderBy(*values.ordered(keys)) if keys else f.df).limit(o.n)
            elif isinstance(o, Restrict):
                low.filtered(o.where)
            elif isinstance(o, Within):
                both = [r.df(ordered=r._cut()).select(*[q(c).alias(f"__in_{c}") for c in self._identity()]) for r in o.others]
                held = both[0] if len(both) == 1 else both[0].union(both[1])
                test = [q(c).eqNullSafe(q(f"__in_{c}")) for c in self._identity()]
                f.df = f.df.join(held, test, "left_semi")
            else:
                f.df = f.df.where(F.coalesce(o.test(f.df), F.lit(False)))
        return keys

    def _identity(self) -> tuple[str, ...]:
        if not self.cls.order:
            raise QueryError(f"'{self.cls.name}' has nothing that tells its objects apart")
        return self.cls.order

    def _laid(self) -> tuple[DataFrame, list[tuple[Column, bool]]]:
        """(rows after the ordering, sort keys)."""
        low = Lowering(self.catalog, self.cls.name)
        low.filtered(self.where)
        keys = self._fold(low, self.order)
        return low.root.df, keys

    def _own(self, df: DataFrame) -> DataFrame:
        return df.select(*[q(c) for c in self.cls.frame.columns])

    def _single(self, low: Lowering, path: Path) -> Scalar:
        x = low.operand(low.root, self.cls, "", path)
        if not isinstance(x, Scalar):
            raise QueryError(f"Cannot sort or be distinct on '{path}', which is a list")
        return x

    def _valued(self, prop: str) -> tuple[DataFrame, Scalar]:
        low = Lowering(self.catalog, self.cls.name)
        low.filtered(self.where)
        if self._cut():
            self._fold(low, self.order)
        x = low.operand(low.root, self.cls, "", _path(prop))
        if not isinstance(x, Scalar):
            raise QueryError(f"'{prop}' is no single value")
        return low.root.df, x

    def backlinks(self, key: Any, origin: str, link: str) -> "Results":
        """The objects of class ``origin`` whose link (or list of links) leads to this class's object of that key: the view from its other end."""
        p = self.catalog.get(origin).find(link)
        if p.kind not in ("link", "links") or p.target != self.cls.name:
            raise QueryError(f"'{origin}.{link}' doesn't link to '{self.cls.name}'")
        return Results(self.catalog, origin, Compare("==", Path((link,)), Const(Key(key))))

    # -- aggregates; these honour the ordering

    def aggregates(self, **wanted: tuple[str, str]) -> DataFrame:
        """One row: name = (sum, min, max, avg or count, property). One pass over the objects."""
        low = Lowering(self.catalog, self.cls.name)
        low.filtered(self.where)
        if self._cut():
            self._fold(low, self.order)
        out = []
        for name, (fn, prop) in wanted.items():
            if fn == "count":
                out.append(F.count(F.lit(1)).alias(name))
                continue
            x = low.operand(low.root, self.cls, "", _path(prop))
            if not values.is_number(x.kind) and not (x.kind.startswith("timestamp") and fn in ("min", "max")):
                raise QueryError(f"Operation '{fn}' isn't known for type '{x.kind}'")
            out.append(values.aggregate(fn, x.col, x.kind).alias(name))
        return low.root.df.agg(*out)

    def _one(self, fn: str, prop: str = ""):
        return self.aggregates(v=(fn, prop)).first()[0]

    def sum(self, prop: str):
        return self._one("sum", prop)

    def min(self, prop: str):
        return self._one("min", prop)

    def max(self, prop: str):
        return self._one("max", prop)

    def average(self, prop: str):
        return self._one("avg", prop)

    def count(self) -> int:
        return self._one("count")

    def at_extreme(self, prop: str, largest: bool = True) -> DataFrame:
        """Key and value of the object at the largest or smallest value; the first of equals by key."""
        df, x = self._valued(prop)
        good = df.where(x.col.isNotNull() & (~F.isnan(x.col) if x.kind in values.REAL else F.lit(True)))
        return good.orderBy(x.col.desc() if largest else x.col.asc(), q(self.cls.key)).limit(1).select(q(self.cls.key), x.col.alias("value"))

    def count_equal(self, prop: str, value: Any) -> int:
        return self.filter(f"{prop} == $0", value).count()

    def unique_values(self, prop: str) -> DataFrame:
        df, x = self._valued(prop)
        return df.agg(F.count_distinct(x.col).alias("unique_values"))

    # -- access

    def first(self):
        return self.df().head()

    def last(self):
        """The last object: the first one of the order turned round."""
        df, keys = self._laid()
        if not keys:
            raise QueryError("The last object needs a class with an order, or a sort")
        return self._own(df.orderBy(*values.ordered(keys, turned=True)).limit(1)).head()

    def get(self, n: int):
        """The object at position ``n`` from 0, or None. A top-k of n + 1 rows."""
        if n < 0:
            raise QueryError("A position isn't negative")
        df, keys = self._laid()
        return self._own((df.orderBy(*values.ordered(keys)) if keys else df).offset(n).limit(1)).head()

    def index_of(self, key: Any) -> int:
        """Position of the object, or -1: the number of objects that come before it."""
        df, keys = self._laid()
        names = [f"__s{i}" for i in range(len(keys))]
        df = df.select(q(self.cls.key).alias("__key"), *[k.alias(n) for (k, _), n in zip(keys, names)])
        me = df.where(F.col("__key") == F.lit(key)).head()
        if me is None:
            return -1
        before, same = F.lit(False), F.lit(True)
        for n, (_, up) in zip(names, keys):
            v = F.lit(me[n]).cast(df.schema[n].dataType)
            # Nulls stand first when ascending.
            less = F.coalesce(F.col(n) < v, F.col(n).isNull() & v.isNotNull()) if up else F.coalesce(F.col(n) > v, F.col(n).isNotNull() & v.isNull())
            before, same = before | (same & less), same & F.col(n).eqNullSafe(v)
        return df.where(before).count()

    def find(self, text: str, *args: Any):
        return self.filter(text, *args).first()

    def query_count(self) -> int:
        """What a query counts: all objects of its predicate, whatever sorts, distincts and limits are attached."""
        return self._with(order=()).count()

    def eval_object(self, key: Any) -> bool:
        """Whether the object of this key satisfies the predicate."""
        low = Lowering(self.catalog, self.cls.name)
        return not low.filtered(self.where).where(q(self.cls.key) == F.lit(key)).isEmpty()

    def links(self) -> dict[str, str]:
        return {p.col: p.target for p in self.cls.properties.values() if p.kind == "link"}

    def to_json(self, mode: str = "json") -> DataFrame:
        """One JSON text an object; see ``sources.text_files``."""
        from ..sources.text_files import to_json

        return to_json(self.df(), mode, self.links())

    def snapshot(self, path: str) -> "Results":
        """The objects as they are now, written once: later changes of the class don't show."""
        spark = self.catalog.spark
        self.df().write.mode("overwrite").parquet(path)
        out = Catalog(spark)
        out.classes = dict(self.catalog.classes)
        out.property_alias, out.class_alias = self.catalog.property_alias, self.catalog.class_alias
        out.add(self.cls.name, spark.read.parquet(path), self.cls.key, list(self.cls.properties.values()), fulltext=self.cls.fulltext)
        return Results(out, self.cls.name)

    # -- sections

    def sections(self, key: str | Callable[[Column], Column], prop: str | None = None) -> DataFrame:
        """Objects by section, in the order in which sections first appear: columns section, section_no, row_no and the objects' own.

        ``key`` is "first_letter" (of ``prop``) or a function from the property's Column.
        """
        low = Lowering(self.catalog, self.cls.name)
        low.filtered(self.where)
        keys = self._fold(low, self.order)
        if not keys:
            raise QueryError("Sections need a class with a key or a sort")
        x = low.operand(low.root, self.cls, "", _path(prop)) if prop else None
        section = F.coalesce(F.substring(x.col, 1, 1), F.lit("")) if key == "first_letter" else key(x.col if x else None)
        # Sections are few beside rows: their order comes from each one's first row, found by partial aggregation.
        own = self.cls.frame.columns
        by = values.ordered(keys)
        rows = low.root.df.withColumn("section", section).withColumn("row_no", F.row_number().over(Window.partitionBy(section).orderBy(*by)) - 1)
        firsts = rows.where("row_no = 0").withColumn("section_no", F.row_number().over(Window.orderBy(*by)) - 1).select(F.col("section").alias("__s"), "section_no")
        return rows.join(firsts, F.col("section").eqNullSafe(F.col("__s"))).select("section", "section_no", "row_no", *[q(c) for c in own])


def _query(where: Any, args: Sequence[Any] = ()) -> Query:
    """Predicate text, a query under construction or a tree as a query."""
    if isinstance(where, str):
        return parse(where, args)
    if hasattr(where, "tree"):
        where = where.tree()
    return where if isinstance(where, Query) else Query(where)


def _path(text: str) -> Path:
    p = Parser(text)
    return p.path(None)

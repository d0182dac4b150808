"""Writes: creating, changing and removing objects as new versions of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..plans.lower import Lowering, q
from ..plans.parser import parse
from ..plans.tree import QueryError
from .results import Results


MODES = ("keep", "never", "all", "changed")


def create(old: DataFrame, new: DataFrame, key: str, mode: str = "keep") -> DataFrame:
    """Objects by primary key. Mode for those that are there already: keep (they stay as they are), never (the running job fails),
    all (the given columns are set), changed (set where they differ, which leaves the same rows as ``all``)."""
    if mode not in MODES:
        raise QueryError(f"'{mode}' is none of {', '.join(MODES)}")
    if mode == "keep":
        return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)
    if mode == "never":
        there = old.select(q(key).alias("__there"))
        failed = F.raise_error(F.concat(F.lit("There is an object with the key "), q(key).cast("string")))
        met = new.join(there, q(key) == q("__there"), "left").withColumn(key, F.when(q("__there").isNull(), q(key)).otherwise(failed).cast(new.schema[key].dataType)).drop("__there")
        return old.unionByName(met, allowMissingColumns=True)
    given = [c for c in new.columns if c != key]
    n = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__new_{c}") for c in given])
    both = old.join(n, q(key) == q("__k"), "full")
    there = q("__k").isNotNull()
    return both.select(F.coalesce(q(key), q("__k")).alias(key), *[F.when(there, q(f"__new_{c}")).otherwise(q(c)).alias(c) if c in given else q(c) for c in old.columns if c != key])


def ingest(catalog: Catalog, cls: str, rows: DataFrame, path: str) -> None:
    """Append objects to an asymmetric class: they are written and never looked up, so nothing is read or compared."""
    c = catalog.get(cls)
    if not c.asymmetric:
        raise QueryError(f"'{cls}' isn't asymmetric")
    rows.select(*[q(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in c.kinds.items()]).write.mode("append").parquet(path)


def copy_into(source: Catalog, cls: str, target: Catalog, where: str = "TRUEPREDICATE", *args) -> dict[str, DataFrame]:
    """Frames of ``target``'s classes after the objects of ``source`` that satisfy ``where`` were copied there, with all that
    their links lead to, step by step. Columns are cast to the target's types, those that it lacks are left out, and an object whose key is there already is set."""
    picked: dict[str, DataFrame] = {cls: Results(source, cls, where, args=args).df(ordered=False)}
    frontier = dict(picked)
    while frontier:
        asked: dict[str, DataFrame] = {}
        for name, rows in frontier.items():
            for p in source.get(name).properties.values():
                if p.kind in ("link", "links") and p.target in target.classes:
                    to = F.explode(q(p.col)) if p.kind == "links" else q(p.col)
                    keys = rows.select(to.alias("__to")).select(q("__to").cast("string").alias("__to")).where("__to IS NOT NULL")
                    asked[p.target] = asked[p.target].union(keys) if p.target in asked else keys
        frontier = {}
        for name, keys in asked.items():
            c = source.get(name)
            rows = c.frame.join(keys.distinct(), q(c.key).cast("string") == q("__to"), "left_semi")
            if name in picked:  # links back to a class: only what is new goes on
                rows = rows.join(picked[name].select(q(c.key).alias("__had")), q(c.key) == q("__had"), "left_anti")
                if rows.isEmpty():
                    continue
                picked[name] = picked[name].union(rows)
            else:
                picked[name] = rows
            frontier[name] = rows
    out = {}
    for name, rows in picked.items():
        c = target.get(name)
        cast = rows.select(*[q(n).cast(k).alias(n) for n, k in c.kinds.items() if n in rows.columns])
        out[name] = create(c.frame, cast, c.key, "all").select(*c.frame.columns)
    return out


def update(catalog: Catalog, cls: str, where: str, changes: dict[str, Column], *args) -> DataFrame:
    """The class's frame with ``changes`` made to the objects that satisfy ``where``. add: ``{"n": F.col("n") + 1}``."""
    low = Lowering(catalog, cls)
    hit = low.test(low.root, low.cls, "", parse(where, args).where)
    df = low.root.df.withColumn("__hit", hit)
    return df.select(*[F.when(q("__hit"), changes[c]).otherwise(q(c)).alias(c) if c in changes else q(c) for c in low.cls.frame.columns])


def remove(catalog: Catalog, cls: str, where: str, *args) -> DataFrame:
    """The objects that stay. A limit or distinct in ``where`` decides which go."""
    gone = Results(catalog, cls, where, args=args)
    if not gone.order:
        return Results(catalog, cls, f"!({gone.where})").df()
    key = catalog.get(cls).key
    return catalog.get(cls).frame.join(gone.df().select(key), key, "left_anti")


def cascade(catalog: Catalog, cls: str, kept: DataFrame) -> dict[str, DataFrame]:
    """Frames of all classes after ``cls`` was reduced to ``kept``: links to lost objects are nullified, and embedded children of lost ones go with them."""
    out, todo = {cls: kept}, [cls]
    while todo:
        parent = catalog.get(todo.pop())
        keys = out[parent.name].select(q(parent.key).alias("__k"))
        for child, link in catalog.backlinks_to(parent.name):
            df = out.get(child.name, child.frame)
            if link.kind == "link":
                met = df.join(keys, q(link.col) == q("__k"), "left")
                if child.embedded:
                    out[child.name] = met.where("__k IS NOT NULL").drop("__k")
                    todo.append(child.name) if child.key else None
                else:
                    out[child.name] = met.withColumn(link.col, q("__k").cast(child.kinds[link.col])).drop("__k")
            else:
                # Lists lose elements: exploded, met with the keys and gathered again in order.
                e = df.select(q(child.key), F.posexplode(q(link.col)).alias("__p", "__t")).join(keys, q("__t") == q("__k"))
                lists = e.groupBy(child.key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__t"))), lambda x: x["__t"]).alias("__l"))
                out[child.name] = df.join(lists, child.key, "left").withColumn(link.col, F.when(q(link.col).isNotNull(), F.coalesce(q("__l"), F.array().cast(child.kinds[link.col])))).drop("__l").select(*df.columns)
    return out


def nullify(catalog: Catalog, cls: str) -> dict[str, DataFrame]:
    """All frames with links to objects that aren't there made null."""
    return cascade(catalog, cls, catalog.get(cls).frame)

"""What changed inside of objects between two versions: properties, lists, dictionaries, sections, and values over links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.results import Results, _path
from ..plans.lower import Array, Lowering, Many, Scalar, q
from .changes import diff


def object_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, change, property, before, after): a row for each property that changed, its values as JSON; of a deleted object one row without a property."""
    columns = columns or [c for c in new.columns if c != key]
    side = lambda df, n: df.select(F.col(key).alias(f"k{n}"), F.struct(*columns).alias(n))
    both = side(old, "a").join(side(new, "b"), F.col("ka").eqNullSafe(F.col("kb")))
    text = lambda c: F.to_json(F.struct(c.alias("v")))
    each = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("property"), text(F.col(f"a.{c}")).alias("before"), text(F.col(f"b.{c}")).alias("after"))) for c in columns]
    changed = both.select(F.col("ka").alias(key), F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    changed = changed.select(key, F.lit("modification").alias("change"), "x.*")
    none = F.lit(None).cast("string")
    gone = old.join(new.select(F.col(key).alias("__k")), q(key).eqNullSafe(q("__k")), "left_anti").select(key, F.lit("deletion").alias("change"), none.alias("property"), none.alias("before"), none.alias("after"))
    return changed.union(gone)


def edit_script(old: list, new: list) -> tuple[list[int], list[int]]:
    """(positions in ``old`` to delete, positions in ``new`` to insert), as few as there can be: all outside of a longest common subsequence."""
    a, b = 0, 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    while b < min(len(old), len(new)) - a and old[len(old) - 1 - b] == new[len(new) - 1 - b]:
        b += 1
    places: dict = {}
    for j in range(a, len(new) - b):
        places.setdefault(new[j], []).append(j)
    ends: list[int] = []  # the smallest last position of a common subsequence of each length
    made: list[tuple[int, int, int]] = []  # (position in old, in new, the pair before)
    last: list[int] = []
    from bisect import bisect_left

    for i in range(a, len(old) - b):
        for j in reversed(places.get(old[i], ())):
            at = bisect_left(ends, j)
            made.append((i, j, last[at - 1] if at else -1))
            if at == len(ends):
                ends.append(j)
                last.append(len(made) - 1)
            else:
                ends[at], last[at] = j, len(made) - 1
    keep_old, keep_new, k = set(), set(), last[-1] if last else -1
    while k >= 0:
        i, j, k = made[k]
        keep_old.add(i)
        keep_new.add(j)
    return [i for i in range(a, len(old) - b) if i not in keep_old], [j for j in range(a, len(new) - b) if j not in keep_new]


def list_changes(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, deletions, insertions, modifications) of objects in both versions whose list changed.

    Deletions are positions in the old list, insertions in the new one, as few as there can be; a position that is in both is a modification.
    Only lists that differ are compared element by element.
    """
    side = lambda df, n: df.select(F.col(key).alias(f"k{n}"), F.coalesce(F.col(column), F.array()).alias(n))
    both = side(old, "a").join(side(new, "b"), F.col("ka").eqNullSafe(F.col("kb"))).where("NOT (a <=> b)")
    kind = old.schema[key].dataType.simpleString()
    ddl = f"k {kind}, deletions array<int>, insertions array<int>"
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = old.sparkSession.createDataFrame([], ddl)
    schema = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = lambda v: [x if not isinstance(x, (list, dict)) else repr(x) for x in v]
        for batch in batches:
            both = [edit_script(hashed(a), hashed(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *[pa.array([s[k] for s in both], schema.field(k + 1).type) for k in (0, 1)]], schema=schema)

    found = both.select("ka", "a", "b").mapInArrow(run, ddl)
    same = F.array_intersect("deletions", "insertions")
    return found.select(F.col("k").alias(key), F.array_except("deletions", same).alias("deletions"), F.array_except("insertions", same).alias("insertions"), F.array_sort(same).alias("modifications"))


def dictionary_changes(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, deletions, insertions, modifications): keys of the dictionaries of objects in both versions, sorted."""
    side = lambda df, n: df.select(F.col(key).alias(f"k{n}"), F.col(column).alias(n))
    both = side(old, "a").join(side(new, "b"), F.col("ka").eqNullSafe(F.col("kb")))
    none = F.array().cast("array<string>")
    a, b = (F.coalesce(F.map_keys(c), none) for c in ("a", "b"))
    met = F.filter(F.array_intersect(a, b), lambda k: ~F.try_element_at("a", k).eqNullSafe(F.try_element_at("b", k)))
    out = both.select(F.col("ka").alias(key), F.array_sort(F.array_except(a, b)).alias("deletions"), F.array_sort(F.array_except(b, a)).alias("insertions"), F.array_sort(met).alias("modifications"))
    return out.where("size(deletions) + size(insertions) + size(modifications) > 0")


def section_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(section, change, deletions, insertions, modifications) from two frames that ``Results.sections`` gave.

    Change is insertion or deletion of the whole section, else modification; the others count objects that left, came to, or changed in the section.
    """
    side = lambda df, n: df.select(F.col("section").alias(f"s{n}"), F.col(key).alias(f"k{n}"), F.struct(*[c for c in df.columns if c not in ("section", "section_no", "row_no", key)]).alias(n))
    both = side(old, "a").join(side(new, "b"), F.col("sa").eqNullSafe(F.col("sb")) & F.col("ka").eqNullSafe(F.col("kb")), "full")
    by = both.withColumn("section", F.when(F.col("a").isNotNull(), F.col("sa")).otherwise(F.col("sb"))).groupBy("section").agg(
        F.count_if(F.col("b").isNull()).alias("deletions"), F.count_if(F.col("a").isNull()).alias("insertions"), F.count_if(~F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).alias("modifications"), F.count("*").alias("n")
    )
    kind = F.when(F.col("insertions") == F.col("n"), "insertion").when(F.col("deletions") == F.col("n"), "deletion").otherwise("modification")
    return by.where("deletions + insertions + modifications > 0").select("section", kind.alias("change"), "deletions", "insertions", "modifications")


def watched(results: Results, *paths: str) -> DataFrame:
    """The results' key with a column for what each path leads to: a value, a list, or of many linked objects their number and a sum of hashes that
    doesn't depend on their order. A change of any of these, however many links away, is a change of the row."""
    low = Lowering(results.catalog, results.cls.name)
    low.filtered(results.where)
    results._fold(low, results.order)
    out = []
    for n, text in enumerate(paths):
        x = low.operand(low.root, results.cls, "", _path(text))
        if isinstance(x, Many):
            leaf = x.leaf.col if isinstance(x.leaf, (Scalar, Array)) else q(x.frame.base + x.frame.cls.key)
            col = low.per_parent(low.root, x, F.struct(F.count("*"), F.sum(F.xxhash64(leaf).cast("decimal(20,0)"))))
        else:
            col = x.col
        # Joins of later paths keep the column.
        low.root.df = low.root.df.withColumn(f"__watched{n}", col)
        out.append(q(f"__watched{n}").alias(text))
    return low.root.df.select(q(results.cls.key), *out)


def deep_changes(old: Results, new: Results, *paths: str) -> DataFrame:
    """``diff`` of results by what ``paths`` lead to, also over links: (key, change, columns), where columns are the paths that changed."""
    names = {f"p{n}": p for n, p in enumerate(paths)}
    short = lambda r: watched(r, *paths).toDF(r.cls.key, *names)
    found = diff(short(old), short(new), old.cls.key)
    back = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return found.withColumn("columns", F.transform("columns", lambda c: back[c]))

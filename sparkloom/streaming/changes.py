"""Changes between two versions of a result, and live queries that report them for each micro-batch."""

from __future__ import annotations

import atexit
import json
from array import array
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import Files, folder


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, change, columns): insertions, deletions, modifications with the columns that changed. ``columns`` restricts what counts.

    Keys meet in one full outer join of the columns that count; a null key meets a null key.
    """
    columns = columns or [c for c in new.columns if c != key]
    row = lambda df, n: df.select(F.col(key).alias(f"k{n}"), F.struct(*columns).alias(n))
    both = row(old, "a").join(row(new, "b"), F.col("ka").eqNullSafe(F.col("kb")), "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    kind = F.when(F.col("a").isNull(), "insertion").when(F.col("b").isNull(), "deletion").when(F.size(changed) > 0, "modification")
    both = both.withColumn("change", kind).where("change IS NOT NULL")
    return both.select(F.coalesce("ka", "kb").alias(key), "change", F.when(F.col("change") == "modification", F.array_sort(changed)).otherwise(F.array().cast("array<string>")).alias("columns"))


#: Whoever sets it gets every object whose rank changed, not the fewest, from ``moves`` with over so many runs. Nothing here does.
RUNS: int | None = None


def moves(old: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """(key, from, to): the fewest objects of both versions whose move turns the one order into the other, with their positions.

    Objects are ranked among those in both versions. A run of objects that are neighbours in both orders moves as one, so what is searched is
    as large as the change, not the table: the runs that stay are the increasing sequence of most objects. The search takes n log n steps and
    about 80 bytes for each of n runs, on the driver.
    """
    spark = old.sparkSession
    both = old.select(key, F.col(position).alias("from")).join(new.select(key, F.col(position).alias("to")), key)
    both, path = _ranked(both, ["from", key], "__r")
    both = ranks(both, ["to", key], "__s")
    Files(spark).delete(path)
    # Neighbours are looked for in blocks of 65,536 ranks. A run that goes on into the next block counts as two, which stay or go together.
    before = F.lag("__s").over(Window.partitionBy(F.shiftright("__r", 16)).orderBy("__r"))
    runs = both.select("__r", "__s", before.alias("__b")).where("__b IS NULL OR __b + 1 <> __s").select("__r", "__s").toArrow().sort_by("__r")
    if RUNS is not None and runs.num_rows > RUNS:
        return both.where("__r <> __s").select(key, "from", "to")
    starts, places = runs["__r"].to_numpy(), runs["__s"].to_numpy()
    ends = np.append(starts, both.count() + 1)[1:]
    gone = ~staying(places, ends - starts)
    spans = spark.createDataFrame(pa.table({"a": starts[gone], "b": ends[gone] - 1})).select(F.explode(F.sequence("a", "b")).alias("__r"))
    return both.join(spans, "__r").select(key, "from", "to")


def staying(places: Sequence[int], weights: Sequence[int]) -> np.ndarray:
    """Which items are in the increasing subsequence of ``places`` of most weight; of several such ones, that of the lowest places from its end on."""
    n = len(places)
    order = np.empty(n, np.int64)
    order[np.argsort(places)] = np.arange(1, n + 1)
    order, weights = (array("q", np.asarray(x, np.int64).tobytes()) for x in (order, weights))
    order.append(0)
    # A Fenwick tree by place of the last item of the best sequence, the weight of that which ends in an item, and the item before it; n is none.
    best, total, link = array("q", [n]) * (n + 1), array("q", [0]) * (n + 1), array("q", [n]) * n
    for i in range(n):
        place = order[i]
        at, top = place - 1, n
        while at > 0:
            if total[best[at]] >= total[top]:
                top = best[at]
            at &= at - 1
        link[i], mine, at = top, total[top] + weights[i], place
        total[i] = mine
        # Wider nodes hold what is better still.
        while at <= n and (mine > total[best[at]] or mine == total[best[at]] and place < order[best[at]]):
            best[at] = i
            at += at & -at
    i, at = n, n
    while at > 0:
        if total[best[at]] >= total[i]:
            i = best[at]
        at &= at - 1
    out = np.zeros(n, bool)
    while i < n:
        out[i], i = True, link[i]
    return out


def ranks(df: DataFrame, order: list[str], position: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with each row's rank from 1 by ``order``, as ``row_number`` over all rows gives it, nulls first.

    Rows are sorted by ranges of the order and written once, numbered within each range; when read they are moved by the counts of the ranges
    before. Only rows equal in all of ``order`` have to stay together.
    """
    return _ranked(df, order, position, keep)[0]


def _ranked(df: DataFrame, order: list[str], position: str, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``ranks``, and the folder that they are read from."""
    spark = df.sparkSession
    path = folder(spark, "ranks")
    # The number of a range and, in the lower 33 bits, of a row in it.
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(position, F.monotonically_increasing_id())
    dealt = dealt.select(*[c for c in dealt.columns if keep is None or c in (*keep, position)])
    dealt.write.parquet(path)
    atexit.register(_forget, spark, path)
    rows, at = spark.read.schema(dealt.schema).parquet(path), F.shiftright(position, 33).cast("int")
    counts = {r["at"]: r["count"] for r in rows.groupBy(at.alias("at")).count().collect()}
    before = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    own = F.col(position).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(position, own + F.element_at(F.array(*[F.lit(b + 1).cast("long") for b in before]), at + 1)), path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        Files(spark).delete(path)
    except Exception:  # noqa: BLE001 - the JVM may have ended first
        pass


@dataclass
class LiveQuery:
    """A query over state tables that is run again after each batch which touches them."""

    name: str
    query: Callable[[dict[str, DataFrame]], DataFrame]
    key: str
    tables: frozenset[str]
    text: str = ""
    columns: list[str] | None = None
    state: str = "uncommitted"  # then pending, bootstrapping, awaiting mark, complete or error; superseded where another one took its name
    version: int = -1
    error: str | None = None


@dataclass
class Subscriptions:
    """Named live queries: one of the same name is replaced, one of the same text is kept."""

    items: dict[str, LiveQuery] = field(default_factory=dict)

    def put(self, q: LiveQuery) -> LiveQuery:
        for other in self.items.values():
            if other.name != q.name and q.text and other.text == q.text:
                return other
        if q.name in self.items and self.items[q.name].text == q.text and q.text:
            return self.items[q.name]
        if q.name in self.items:
            self.items[q.name].state = "superseded"
        q.state = "pending"
        self.items[q.name] = q
        return q

    def remove(self, name: str) -> bool:
        return self.items.pop(name, None) is not None


class Live:
    """State tables as versioned Parquet below ``root``; ``apply`` is a foreachBatch function.

    A batch is written as it comes and merged when read, so it costs what it holds, not what the table holds; every ``compact`` batches
    become one. Erased objects stay as marks, so that an older row that arrives late doesn't bring them back. What versions there are is kept in
    a file below ``root``, so a new driver goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, root: str, compact: int = 8):
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact
        self.files = Files(spark)
        known = json.loads(self.files.read(f"{self.root}/_live.json") or "{}")
        self.versions: dict[str, int] = known.get("versions", {})
        self.parts: dict[str, list[list[int]]] = known.get("parts", {})
        self.merge: dict[str, list[str]] = known.get("merge", {})
        self.subscriptions = Subscriptions()

    def path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v={version}"

    def _rows(self, name: str, version: int) -> DataFrame:
        """All that a version is made of, marks of erased objects included."""
        out = None
        for v in self.parts[name][version]:
            part = self.spark.read.parquet(self.path(name, v))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return latest(out, *self.merge[name]) if name in self.merge and len(self.parts[name][version]) > 1 else out

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return there(self._rows(name, self.versions[name] if version is None else version))

    def write(self, name: str, df: DataFrame, parts: list[int] | None = None) -> int:
        """A new version; readers of older ones keep theirs. ``parts``: earlier ones that it goes on from."""
        v = self.versions.get(name, -1) + 1
        df.write.mode("overwrite").parquet(self.path(name, v))
        self.versions[name] = v
        self.parts.setdefault(name, []).append([*(parts or []), v])
        self.files.write(f"{self.root}/_live.json", json.dumps({"versions": self.versions, "parts": self.parts, "merge": self.merge}))
        return v

    def apply(self, name: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
        """Upserts of a stream into a table: the row of the largest ``order`` for each key; ``__deleted`` rows erase."""

        def batch(df: DataFrame, epoch: int) -> None:
            if df.isEmpty():
                return
            self.merge[name] = [key, order]
            parts = self.parts[name][self.versions[name]] if name in self.versions else []
            if len(parts) >= self.compact:
                df, parts = self._rows(name, self.versions[name]).unionByName(df, allowMissingColumns=True), []
            self.write(name, latest(df, key, order), parts)
            self.notify({name})

        return batch

    def notify(self, changed: set[str]) -> None:
        """Run again what depends on changed tables and write its change set."""
        for q in self.subscriptions.items.values():
            if q.state != "pending" and not q.tables & changed or not q.tables <= self.versions.keys():
                continue
            q.state = "bootstrapping" if q.version < 0 else q.state
            try:
                new = q.query({t: self.table(t) for t in q.tables})
                had = f"query_{q.name}" in self.versions
                v = self.write(f"query_{q.name}", new)
                q.state = "awaiting mark" if q.version < 0 else q.state
                old = self.table(f"query_{q.name}", v - 1) if had else self.spark.createDataFrame([], new.schema)
                diff(old, self.table(f"query_{q.name}"), q.key, q.columns).write.mode("overwrite").parquet(self.path(f"changes_{q.name}", v))
                q.state, q.version, q.error = "complete", v, None
            except Exception as e:
                q.state, q.error = "error", str(e)
                raise


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the row of the largest ``order``, marks of erased objects included."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, F.hash(*rows.columns))).alias("r")).select("r.*")


def there(rows: DataFrame) -> DataFrame:
    """Rows without those marked __deleted."""
    return rows.where(~F.coalesce(F.col("__deleted"), F.lit(False))) if "__deleted" in rows.columns else rows


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, for each key that of the largest ``order``, without those marked __deleted. ``latest`` keeps the marks, which a state needs."""
    return there(latest(old.unionByName(new, allowMissingColumns=True), key, order))

"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

A vector is scaled to length one, rotated by three rounds of random signs and a Walsh-Hadamard
transform, and cut into parts; a part's hash is its coordinate of largest size with its sign, the
nearest corner of the cross-polytope. Parts together name a bucket. Each of ``TABLES`` rotations gives a vector its
own bucket and ``PROBES`` further ones, where the part whose runner-up comes closest gives way. Pairs that
share a bucket are verified by their cosine in double precision and counted in the first bucket they share, so
each link counts once though no list of pairs is kept.

Equal vectors meet before hashing: they are one candidate with a weight, so copies cost nothing. A
bucket is worked on in blocks of ``BLOCK`` vectors; one of over ``SPLIT`` is dealt to many tasks by pairs of
blocks, so none gathers it. Each task returns a number of links per vector and stars; components are found by rounds of joins.
The number of hash parts grows with the number of vectors, which keeps ordinary buckets small at every size;
vectors travel only to buckets that hold another one.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows and ids each count as vectors; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, arrow_schema, bound_batches, partitions
from .components import components

COSINE = 0.95
TABLES = 8
PROBES = 3
BLOCK = 512
SPLIT = 4096
SEED = 20_240_601
HASHED = "rid long, weight long, vec binary, own binary, buckets array<long>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def buckets(unit: np.ndarray, parts: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket ids, one row per vector and 1 + ``probes`` columns per table; own bucket first."""
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = unit
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        codes, second, gap = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64), np.empty((n, parts))
        for p in range(parts):
            rng = np.random.default_rng((SEED, t, p, d))
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            size_of = np.abs(y)
            top = np.argpartition(-size_of, 1, axis=1)[:, :2]
            a, b = np.take_along_axis(size_of, top, 1).T
            first = np.where(a >= b, top[:, 0], top[:, 1])
            other = np.where(a >= b, top[:, 1], top[:, 0])
            row = np.arange(n)
            codes[:, p] = first * 2 + (y[row, first] < 0)
            second[:, p] = other * 2 + (y[row, other] < 0)
            gap[:, p] = np.abs(a - b)
        order = np.argsort(gap, axis=1, kind="stable")
        for k in range(1 + probes):
            own = codes.copy()
            # The k-th probe changes the parts whose bits are set in k, in order of how close their runner-up comes.
            for bit in range(parts):
                if k >> bit & 1:
                    at = order[:, bit]
                    own[np.arange(n), at] = second[np.arange(n), at]
            h = np.full(n, t + 1, np.uint64)
            for p in range(parts):
                h = (h ^ own[:, p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, t, k] = h if k < 1 << parts else out[:, t, 0]
    return out.reshape(n, -1)


def _parts(n: int, dim: int) -> int:
    """Hash parts so that a bucket of spread-out vectors holds eight or fewer, at any number of vectors.

    A part tells apart as many corners as ``dim``, raised to a power of two, has directions.
    """
    codes = 2 << max(1, (dim - 1).bit_length())
    parts, room = 1, codes
    while room * 2 < n and parts < 6:
        parts, room = parts + 1, room * codes
    return parts


def _tables(parts: int) -> int:
    """More parts make a link's ends differ more often, so from five parts on twice the tables keep recall above 0.98 at a cosine of 0.95 (64 components)."""
    return TABLES if parts < 5 else 2 * TABLES


def _hash(vectors: DataFrame, parts: int, tables: int, single: bool) -> DataFrame:
    """(rid, weight, vector) -> one row per vector with its packed components and all its buckets in order.

    ``single``: all components are of single precision, and packed so; cosines are always of doubles.
    """
    bound_batches(vectors.sparkSession)
    schema, kind = arrow_schema(HASHED), np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                values = part.column(2).flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                for size in np.unique(sizes):
                    pick = np.flatnonzero(sizes == size)
                    raw = values[starts[pick, None] + np.arange(size)].astype(np.float64)
                    # Scaled by the largest component first, so that neither squares overflow nor vanish.
                    x = raw / np.abs(raw).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    own = [np.unique(r) for r in buckets(x, parts, tables)]
                    rows, ends = pa.array(pick), np.cumsum([0] + [len(o) for o in own])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(rows),
                            part.column(1).take(rows),
                            pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary()),
                            pa.array([o.tobytes() for o in own], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64))).cast(schema.field(4).type),
                        ],
                        schema=schema,
                    )

    return vectors.select("rid", "weight", "v").mapInArrow(run, HASHED)


class _Bucket:
    """Links inside a bucket, or between two blocks of it."""

    def __init__(self, key: int, least: float, kind: type):
        self.key, self.least, self.kind, self.rows = np.uint64(key & 0xFFFFFFFFFFFFFFFF), least, kind, []

    def first_shared(self, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs i, j share no bucket below this one."""
        out = np.empty(len(i), bool)
        for at in range(0, len(i), 8192):
            p, q = own[i[at : at + 8192]], own[j[at : at + 8192]]
            out[at : at + 8192] = ~((p[:, :, None] == q[:, None, :]) & (p < self.key)[:, :, None]).any((1, 2))
        return out

    def links(self, cross: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(links per rid, stars); with ``cross``, only pairs of different blocks."""
        by_size: dict[int, list] = {}
        for r in self.rows:
            by_size.setdefault(len(r[2]), []).append(r)
        counts, stars = [], []
        for rows in by_size.values():
            if len(rows) < 2:
                continue
            x = np.stack([np.frombuffer(r[2], self.kind) for r in rows]).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            norm = np.linalg.norm(x, axis=1)
            rid, weight, side = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 4))
            n, root, own = np.zeros(len(rows), np.int64), np.arange(len(rows)), None
            for a in range(0, len(rows), BLOCK):
                for b in range(a, len(rows), BLOCK):
                    dots = x[a : a + BLOCK] @ x[b : b + BLOCK].T / (norm[a : a + BLOCK, None] * norm[None, b : b + BLOCK])
                    hit = dots >= self.least
                    if a == b:
                        hit &= np.tri(*hit.shape, -1, dtype=bool).T
                    if cross:
                        hit &= side[a : a + BLOCK, None] != side[None, b : b + BLOCK]
                    i, j = np.nonzero(hit)
                    if not len(i):
                        continue
                    if own is None:
                        # Rows end in the largest number, which is below no bucket.
                        own = np.full((len(rows), max(len(r[3]) for r in rows) // 8), np.iinfo(np.uint64).max, np.uint64)
                        for k, r in enumerate(rows):
                            own[k, : len(r[3]) // 8] = np.frombuffer(r[3], np.uint64)
                    i, j = i + a, j + b
                    first = self.first_shared(own, i, j)
                    i, j = i[first], j[first]
                    np.add.at(n, i, weight[j])
                    np.add.at(n, j, weight[i])
                    _join(root, i, j)
            linked = np.flatnonzero(n)
            counts += zip(rid[linked].tolist(), n[linked].tolist())
            moved = np.flatnonzero(root != np.arange(len(rows)))
            stars += zip(rid[moved].tolist(), rid[root[moved]].tolist())
        return counts, stars


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge, in place, the sets of i[k] and j[k]; ``root`` holds each row's smallest fellow before and after."""
    while True:
        u, v = root[i], root[j]
        if (u == v).all():
            return
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root[:] = root[root]


def _verify(dealt: DataFrame, least: float, n: int, single: bool) -> DataFrame:
    """(kind, a, b): kind 0 gives vector a another b links, kind 1 a star edge."""
    schema, kind = arrow_schema("kind int, a long, b long"), np.float32 if single else np.float64

    def emit(bucket: _Bucket | None, cross: bool):
        if bucket is None or len(bucket.rows) < 2:
            return []
        counts, edges = bucket.links(cross)
        return [(0, a, b) for a, b in counts] + [(1, a, b) for a, b in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket, cross, out = None, None, False, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for key, rid, weight, vec, own, a, b, side in zip(*cols):
                if (key, a, b) != at:
                    out += emit(bucket, cross)
                    at, bucket, cross = (key, a, b), _Bucket(key, least, kind), a != b
                bucket.rows.append((rid, weight, vec, own, side))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        out += emit(bucket, cross)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.repartition(n, "bucket", "pa", "pb").sortWithinPartitions("bucket", "pa", "pb").mapInArrow(run, "kind int, a long, b long")


def groups(embeddings: DataFrame, least: float = COSINE, tables: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept (vec_id is its component's smallest)."""
    spark = embeddings.sparkSession
    scratch, n = Scratch(spark), partitions(spark)
    single = isinstance(embeddings.schema[vec_col].dataType.elementType, FloatType)
    v = F.col(vec_col).cast("array<float>" if single else "array<double>")
    bad = F.coalesce(F.size(v) < 1, F.lit(True)) | F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | F.coalesce(F.forall(v, lambda x: x == 0), F.lit(True))
    rows = scratch.keep(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.when(~bad, v).alias("v")), "rows")
    # Equal vectors, component by component, are one candidate with a number of its own.
    distinct = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    distinct = scratch.keep(distinct.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    lengths = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    total, dim = lengths.agg(F.sum("n"), F.max_by("d", "n")).first()
    parts = _parts(total or 0, dim or 1)
    hashed = scratch.keep(_hash(distinct, parts, tables or _tables(parts), single), "hashed")
    # Buckets travel without vectors until those of a single vector are gone, which are most.
    named = hashed.select(F.explode("buckets").alias("bucket"), "rid")
    sizes = named.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    blocks = F.ceil(F.col("size") / SPLIT).cast("int")
    side = F.when(blocks > 1, F.pmod(F.xxhash64("rid", F.lit(7)), blocks).cast("int")).otherwise(0)
    dealt = named.join(sizes, "bucket").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", "rid", F.least("side", "other").alias("pa"), F.greatest("side", "other").alias("pb"), "side")
    dealt = dealt.join(hashed.drop("buckets"), "rid").select("bucket", "rid", "weight", "vec", "own", "pa", "pb", "side")
    found = scratch.keep(_verify(dealt, least, n, single), "found")
    linked = found.where(F.col("kind") == 0).groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("other_links"))
    roots = components(found.where(F.col("kind") == 1).select("a", "b"), scratch)
    named = distinct.select("rid", "first", "weight").join(roots.withColumnRenamed("id", "rid"), "rid", "left").join(linked, "rid", "left")
    named = scratch.keep(named.withColumn("root", F.coalesce("root", "rid")), "named")
    label = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(label, "root").select("rid", "component", (F.coalesce("other_links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = rows.join(distinct.select("v", "rid").join(named, "rid"), "v", "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept")
    )

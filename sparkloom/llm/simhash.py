"""SimHash near-duplicates, linked through BK-trees; near copies by similarity on top of them.

A fingerprint's bit is set where over half of a text's shingle hashes have it. Two fingerprints within
``radius`` bits agree on at least ``blocks - radius`` of any ``blocks`` blocks of their bits, so each
distinct fingerprint is sent to one shard for every choice of that many blocks and its bits there. The number
of blocks follows from the number of fingerprints and from how even each bit is among them, so that ordinary shards stay
small at any size. A shard's fingerprints form a BK-tree: a node's children are keyed by their Hamming distance to it, and a
query follows only edges within the radius. Subtrees that are known to lie in one component are passed over once the query is linked with it,
so a dense shard costs little more than a sparse one.

A shard of over ``ROOM`` fingerprints becomes several trees of about that size. Each of its fingerprints then queries the
other trees too: they are broadcast while all of them together take at most ``BROADCAST`` bytes (measured first), and meet
their queries by a shuffle beyond that. Shards return direct links, one for each component that a fingerprint joins, never
all pairs; components are found by rounds of joins. Copies meet before any of this, as only distinct fingerprints are linked.

Defined results: null, empty and blank texts have fingerprint zero, which is linked like any other; a text of fewer words
than a shingle is one shingle; very long texts are read whole; ties (a bit that half of the shingles have) leave a bit unset; repeated rows and
ids each count; a null doc_id is never a component's label unless no other is there; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches, partitions, whole_keys, with_key
from .components import components

RADIUS = 4
#: Fingerprints in a tree.
ROOM = 32_768
#: Bytes of trees that are broadcast at most.
BROADCAST = 16 << 20
SEED = 42


def shingles(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of a text's shingles of ``size`` words, A-Z in lower case, repeats included; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops, h = [0, *ends[: n - 1].tolist()], (ends[len(words) - n :] - 1).tolist(), xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return majority(shingles(text, shingle))


class BkTree:
    """Integers by Hamming distance: a node's children are keyed by their distance to it.

    ``whole`` marks nodes whose subtree is known to lie in one component of the values linked so far.
    """

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent, self.whole, self.fresh = radius, [], [], [], [], 64

    def top(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def near(self, x: int, every: bool = False) -> list[int]:
        """Nodes within the radius of ``x``: one of each component that has any, or with ``every`` all of them."""
        found, seen, r = [], set(), self.radius
        values, children, whole, top = self.values, self.children, self.whole, self.top
        stack = [0] if values else []
        while stack:
            node = stack.pop()
            if seen and whole[node] and top(node) in seen:
                continue
            d = (values[node] ^ x).bit_count()
            if d <= r:
                if every:
                    found.append(node)
                elif (c := top(node)) not in seen:
                    seen.add(c)
                    found.append(node)
            own = children[node]
            if len(own) <= 2 * r + 1:
                stack += [c for e, c in own.items() if -r <= e - d <= r]
            else:
                stack += [own[e] for e in range(d - r, d + r + 1) if e in own]
        return found

    def add(self, x: int, every: bool = False) -> list[int]:
        """Insert ``x``; returns what ``near`` does, of the values before it."""
        found, me, node, path = self.near(x, every), len(self.values), 0, []
        while me:
            path.append(node)
            d = (self.values[node] ^ x).bit_count()
            own = self.children[node]
            if d not in own:
                own[d] = me
                break
            node = own[d]
        self.values.append(x)
        self.children.append({})
        self.parent.append(me)
        self.whole.append(True)
        for node in found:
            a, b = self.top(me), self.top(node)
            self.parent[max(a, b)] = min(a, b)
        mine = self.top(me)
        for node in path:
            if self.whole[node] and self.top(node) != mine:
                self.whole[node] = False
        if me + 1 == self.fresh:
            # What was apart may have been joined since; looked at again as often as the tree doubles.
            self.refresh()
            self.fresh *= 2
        return found

    def refresh(self) -> None:
        for i in range(len(self.values) - 1, -1, -1):  # children come after their parents
            c = self.top(i)
            self.whole[i] = all(self.whole[k] and self.top(k) == c for k in self.children[i].values())

    def packed(self) -> bytes:
        """The tree as bytes: values, each node's parent and distance to it, components and marks."""
        self.refresh()
        n = len(self.values)
        up, dist = np.full(n, -1, np.int32), np.zeros(n, np.uint8)
        for i, own in enumerate(self.children):
            for d, k in own.items():
                up[k], dist[k] = i, d
        tops = np.array([self.top(i) for i in range(n)], np.int32)
        return b"".join((np.array(self.values, np.uint64).tobytes(), up.tobytes(), tops.tobytes(), dist.tobytes(), np.array(self.whole, np.uint8).tobytes()))

    @classmethod
    def unpacked(cls, data: bytes, radius: int) -> "BkTree":
        tree, n = cls(radius), len(data) // 18
        up, tops = np.frombuffer(data, np.int32, 2 * n, 8 * n).reshape(2, n)
        dist, whole = np.frombuffer(data, np.uint8, 2 * n, 16 * n).reshape(2, n)
        tree.values, tree.parent, tree.whole = np.frombuffer(data, np.uint64, n).tolist(), tops.tolist(), (whole > 0).tolist()
        tree.children = [{} for _ in range(n)]
        for k, (i, d) in enumerate(zip(up.tolist(), dist.tolist())):
            if i >= 0:
                tree.children[i][d] = k
        return tree


# -- shards


def layout(n: int, share: list[float], radius: int) -> list[int]:
    """Masks of the bits that a shard's fingerprints share, one mask for each choice of blocks.

    ``share``: how many of the n fingerprints have each bit. Bits are dealt to blocks so that each block tells apart about as many;
    the number of blocks is the one that costs least: rows of shards, and comparisons in them.
    """
    entropy = [0.0 if p <= 0 or p >= 1 else -p * log2(p) - (1 - p) * log2(1 - p) for p in share]
    best: tuple[float, list[int]] | None = None
    for blocks in range(radius + 1, radius + 8):
        masks, told = [0] * blocks, [0.0] * blocks
        for bit in sorted(range(len(share)), key=lambda b: -entropy[b]):
            k = min(range(blocks), key=lambda j: (told[j], masks[j].bit_count()))
            masks[k] |= 1 << bit
            told[k] += entropy[bit]
        chosen = list(combinations(range(blocks), blocks - radius))
        cost = sum(1 + 0.2 * n / 2 ** sum(told[j] for j in c) for c in chosen)
        if best is None or cost < best[0]:
            best = cost, [reduce(lambda a, j: a | masks[j], c, 0) for c in chosen]
    return best[1]


def _shards(distinct: DataFrame, radius: int) -> DataFrame:
    """(key, fp): a row for every choice of blocks."""
    bits = [F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    n, *ones = distinct.agg(F.count("*"), *bits).first()
    keys = []
    for k, mask in enumerate(layout(n, [abs(x or 0) / max(n, 1) for x in ones], radius)):
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return edge[:-1], edge[1:]


def _edges(a: list[int], b: list[int], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (a, b)], schema=schema)


def grown(values: list[int], radius: int) -> tuple[BkTree, list[int], list[int]]:
    """A tree of ``values`` and the links found while it grew."""
    tree, a, b = BkTree(radius), [], []
    for x in values:
        for node in tree.add(x):
            a.append(x)
            b.append(tree.values[node])
    return tree, a, b


def _inside(sharded: DataFrame, radius: int, n: int) -> DataFrame:
    """Links inside shards of at most about ``ROOM``; a task holds one at a time."""
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in whole_keys(batches, 2):
            fps, (lo, hi) = fps.view(np.uint64), _runs(keys)
            two = lo[hi - lo == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            a, b = fps[two + 1].tolist(), fps[two].tolist()
            more = hi - lo > 2
            for i, j in zip(lo[more].tolist(), hi[more].tolist()):
                _, p, q = grown(fps[i:j].tolist(), radius)
                a += p
                b += q
            if a:
                yield _edges(a, b, schema)

    return sharded.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _between(sharded: DataFrame, large: DataFrame, radius: int, n: int, scratch: Scratch) -> DataFrame:
    """Links inside shards of over ``ROOM``: within each tree of a shard, and from its fingerprints to its other trees."""
    spark = sharded.sparkSession
    trees = F.ceil(F.col("n") / ROOM).cast("int")
    dealt = sharded.join(large, "key").select("key", F.pmod(F.xxhash64("fp", F.lit(1)), trees).cast("int").alias("tree"), "fp")
    dealt = scratch.keep(dealt, "dealt")
    grow_ddl, schema = "key long, tree int, packed binary, links binary", arrow_schema("a long, b long")
    grow_schema = arrow_schema(grow_ddl)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, keys, tree, fps in whole_keys(batches, 4):
            for i, j in zip(*_runs(at)):
                # One hash names a key and a tree; should two share it, they are told apart here.
                for k, t in sorted(set(zip(keys[i:j].tolist(), tree[i:j].tolist()))):
                    own = fps[i:j][(keys[i:j] == k) & (tree[i:j] == t)]
                    grown_tree, a, b = grown(own.view(np.uint64).tolist(), radius)
                    row = (k, t, grown_tree.packed(), np.array([a, b], np.uint64).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, grow_schema)], schema=grow_schema)

    place = F.xxhash64("key", "tree")
    made = dealt.select(place.alias("at"), "key", "tree", "fp").repartition(n, "at").sortWithinPartitions("at").mapInArrow(grow, grow_ddl)
    made = scratch.keep(made, "trees")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = np.frombuffer(batch.column(0)[i].as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    own = made.select("links").mapInArrow(links, "a long, b long")
    asked = dealt.where("tree > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("tree") - 1)).alias("tree"), "fp")

    def query(tree: BkTree, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for x in fps.view(np.uint64).tolist():
            for node in tree.near(x):
                a.append(x)
                b.append(tree.values[node])
        if a:
            yield _edges(a, b, schema)

    size = made.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    if size <= BROADCAST:
        shared = spark.sparkContext.broadcast({(r.key, r.tree): bytes(r.packed) for r in made.select("key", "tree", "packed").collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[tuple[int, int], BkTree] = {}
            for batch in batches:
                keys, tree, fps = (batch.column(c).to_numpy() for c in range(3))
                for k, t in sorted(set(zip(keys.tolist(), tree.tolist())) & shared.value.keys()):  # a tree may have got no fingerprint
                    if (k, t) not in known:
                        known[k, t] = BkTree.unpacked(shared.value[k, t], radius)
                    yield from query(known[k, t], fps[(keys == k) & (tree == t)])

        return own.union(asked.mapInArrow(probe, "a long, b long"))
    # Each tree comes before its queries.
    both = made.select(place.alias("at"), "key", "tree", F.lit(None).cast("long").alias("fp"), "packed").union(asked.select(place.alias("at"), "key", "tree", "fp", F.lit(None).cast("binary")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], BkTree] = {}
        for batch in batches:
            keys, tree = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            heads = np.flatnonzero(batch.column(3).is_null().to_numpy(zero_copy_only=False))
            edge = np.unique(np.concatenate([[0], heads, np.flatnonzero((np.diff(keys) != 0) | (np.diff(tree) != 0)) + 1, [len(keys)]])).tolist()
            for i, j in zip(edge, edge[1:]):
                k = int(keys[i]), int(tree[i])
                if batch.column(4)[i].is_valid:
                    known = {k: BkTree.unpacked(batch.column(4)[i].as_py(), radius)}
                    i += 1
                if i < j and k in known:
                    yield from query(known[k], batch.column(3).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64))

    found = both.repartition(n, "at").sortWithinPartitions("at", "key", "tree", F.asc_nulls_first("fp")).mapInArrow(meet, "a long, b long")
    return own.union(found)


def linked(distinct: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp), enough of them to connect all that links connect, each within the radius."""
    n = partitions(distinct.sparkSession)
    bound_batches(distinct.sparkSession)
    sharded = _shards(distinct, radius)
    large = scratch.keep(sharded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > ROOM), "large", small=True)
    if large.isEmpty():
        return _inside(sharded, radius, n)
    return _inside(sharded.join(large, "key", "left_anti"), radius, n).union(_between(sharded, large, radius, n, scratch))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long)."""
    bound_batches(docs.sparkSession)
    schema = arrow_schema("doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(batch.column(1)[i].as_py(), shingle) for i in range(batch.num_rows)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], schema=schema)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def groups(docs: DataFrame, shingle: int = 4, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id linked, itself included)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    prints = scratch.keep(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(scratch.keep(linked(distinct.select("fp"), radius, scratch).distinct(), "links", small=True), scratch)
    # The label of a component is its smallest doc_id.
    member = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = scratch.keep(member.select("fp", "root", "first"), "member")
    label = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(label, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# -- near copies: a Jaccard similarity of 0.8 on five-word shingles

#: Words in a shingle of near copies.
SHINGLE = 5
#: Sets that share a shingle are compared pair by pair up to so many; beyond that, by sketches first.
MANY = 64
#: Sets of such a list that one task compares with each other, or with as many others.
BLOCK = 4_096
#: 64-bit words of a sketch.
SKETCH = 16
#: Sets that the order of shingles is learned from at most, and in how many of these a shingle counts as common.
ORDER_DOCS, COMMON = 50_000, 8
#: Rows that a batch of pairs holds at most, about.
PAIRS = 1 << 16


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles."""
    return np.unique(shingles(text, SHINGLE))


def prefix(s: np.ndarray, common: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(0.8 n) + 1`` of a set of n shingles, rare ones before ``common`` ones (sorted, with their ``levels``), else by hash.

    Two sets of a similarity of 0.8 share at least ceil(0.8 n) shingles of each, so that in any order fixed for all sets these prefixes meet.
    """
    if len(common) and len(s):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, levels[at], 0)))]
    return s[: len(s) - (4 * len(s) + 4) // 5 + 1] if len(s) else s


@lru_cache(MANY)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def may_be_near(n, i, m, j):
    """Whether sets of n and m shingles that share their i-th and j-th may reach 0.8: 9 * overlap >= 4 * (n + m)."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * (np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1) >= 4 * (n + m))


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach a Jaccard similarity of 0.8; two empty ones do."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def sketch(s: np.ndarray) -> bytes:
    """For each of 64 * SKETCH classes of hashes whether an odd number of the set's are in it. Sketches of two sets differ in at most as many places as the sets."""
    odd = np.bincount((s % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class _LongList:
    """Sets that share a shingle, of which some are connected already (``root``), and which pairs of them may be near."""

    def __init__(self, v: np.ndarray, n: np.ndarray, i: np.ndarray, root: np.ndarray, bits: np.ndarray, side: np.ndarray, cross: bool):
        self.v, self.n, self.i, self.side, self.cross = v, n.astype(np.int64), i.astype(np.int64), side, cross
        self.bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(v), SKETCH)
        _, self.part, self.counts = np.unique(root, return_inverse=True, return_counts=True)

    def near(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(of x, of y, distance of sketches) for the pairs of rows x and y that may be near: sets of n and m shingles at 0.8 differ in at most (n + m) / 9."""
        step = max(1, (1 << 18) // max(len(y), 1))
        theirs, size = self.bits[y].T.copy(), self.n[y].astype(np.int32)
        for at in range(0, len(x), step):
            p = x[at : at + step]
            d = np.zeros((len(p), len(y)), np.uint16)
            for mine, other in zip(self.bits[p].T, theirs):
                d += np.bitwise_count(mine[:, None] ^ other)
            good = d <= (self.n[p].astype(np.int32)[:, None] + size) // 9
            if self.cross:
                good &= self.side[p][:, None] != self.side[y]
            a, b = np.nonzero(good)
            i, j = p[a], y[b]
            fits = may_be_near(self.n[i], self.i[i], self.n[j], self.i[j])
            yield i[fits], j[fits], d[a[fits], b[fits]].astype(np.int64)

    def _apart(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of different parts that may be near, with the distance of their sketches, in blocks of rows outside of the largest part."""
        main, every = self.counts.argmax(), np.arange(len(self.v))
        out = np.flatnonzero(self.part != main)
        for at in range(0, len(out), 256):
            found = list(self.near(out[at : at + 256], every))
            a, b, d = (np.concatenate(c) for c in zip(*found))
            p, q = self.part[a], self.part[b]
            good = (p != q) & ((q == main) | (q > p))
            yield a[good], b[good], d[good]

    def forest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close pairs that would connect all parts that may be near: fewer than there are parts."""
        label = np.arange(len(self.counts))

        def top(p: int) -> int:
            while label[p] != p:
                label[p] = label[label[p]]
                p = label[p]
            return p

        for a, b, d in self._apart():
            order = np.argsort(d, kind="stable")
            a, b = a[order], b[order]
            while True:
                while (label[label] != label).any():
                    label[:] = label[label]
                p, q = label[self.part[a]], label[self.part[b]]
                other = p != q
                a, b, p, q = a[other], b[other], p[other], q[other]
                if not len(a):
                    break
                # The closest pair of each part on either side joins it to another one.
                pick, joined = np.unique(np.concatenate([np.unique(c, return_index=True)[1] for c in (p, q)])), []
                for k in pick.tolist():
                    x, y = top(self.part[a[k]]), top(self.part[b[k]])
                    if x != y:
                        label[max(x, y)] = min(x, y)
                        joined.append(k)
                yield a[joined], b[joined]

    def all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of different parts that may be near."""
        for a, b, _ in self._apart():
            yield a, b


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, levels): those that lead many prefixes, over at most about ``ORDER_DOCS`` of the n sets. Any choice is exact; this one keeps lists short."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    some = texts if n <= ORDER_DOCS else texts.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < (ORDER_DOCS << 20) // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(prefix(shingle_set(batch.column(0)[i].as_py()), *none).view(np.int64))], names=["s"])

    found = some.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON).toArrow()
    if not found.num_rows:
        return none
    s, c = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(s)
    return s[order], np.log2(c[order]).astype(np.int64)


def _lists(rows: DataFrame, n: int, of: Callable[[list[np.ndarray]], Iterator[list[np.ndarray]]], ddl: str) -> DataFrame:
    """``of`` over the columns of all rows of each key (the first column), one key at a time; keys of one row are left out."""
    schema, columns = arrow_schema(ddl), len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for cols in whole_keys(batches, columns):
            for lo, hi in zip(*_runs(cols[0])):
                if hi - lo < 2:
                    continue
                for found in of([c[lo:hi] for c in cols]):
                    if len(found[0]):
                        out.append(found)
                        size += len(found[0])
                    if size > PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, ddl)


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts reach the similarity."""
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            good = []
            a = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, own = a[i], shingle_set(batch.column(2)[i].as_py())
                good.append(is_near(own, shingle_set(batch.column(3)[i].as_py())))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    two = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a")
    return scratch.keep(two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), name, small=True)


def near_groups(docs: DataFrame, key: str, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(key, root): the smallest key among each document's near copies. ``key`` has to be a key of type long.

    Links are all pairs of a Jaccard similarity of 0.8 on five-word shingles, up to 64-bit hashes, and nothing below it. Texts with one set of
    shingles are one vertex. Candidates are each verified by their texts:

    1. pairs that the BK-trees link over SimHash fingerprints of the shingles, which join most of a large group's copies;
    2. as that misses pairs at 0.8, all pairs it leaves apart that share a shingle of their ``prefix``. Where over ``MANY`` sets share one,
       pairs whose sketches differ in more places than near sets can are passed over; the closest pair of each two parts that are apart
       comes first, and what this leaves apart after that.

    ``docs`` is read several times and joined by ``key``: best bucketed by it.
    """
    spark = docs.sparkSession
    scratch, n = scratch or Scratch(spark), partitions(spark)
    bound_batches(spark)
    ddl = "key long, x long, y long, fp long"
    schema = arrow_schema(ddl)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[], [], []]
            for i in range(batch.num_rows):
                h = shingles(batch.column(1)[i].as_py(), SHINGLE)
                x = xxhash.xxh3_128_intdigest(np.unique(h).tobytes())
                for c, v in zip(cols, (x & 0xFFFFFFFFFFFFFFFF, x >> 64, majority(h))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols]], schema=schema)

    names = scratch.keep(docs.select(F.col(key), F.col(text_col)).mapInArrow(name, ddl), "names", small=True)
    distinct = scratch.keep(names.groupBy("x", "y").agg(F.min("key").alias("v"), F.min_by("fp", "key").alias("fp")), "distinct")
    texts = docs.select(F.col(key).cast("long").alias("v"), F.col(text_col).alias("text")).join(distinct.select("v"), "v", "left_semi")
    # The first candidates: fingerprints that are equal or linked.
    prints = scratch.keep(distinct.groupBy("fp").agg(F.min("v").alias("v")), "fps")
    equal = distinct.join(prints.withColumnRenamed("v", "a"), "fp").where("v <> a").select("a", F.col("v").alias("b"))
    close = linked(prints.select("fp"), RADIUS, scratch).distinct()
    ends = [prints.select(F.col("fp").alias(c), F.col("v").alias(f"v{c}")) for c in "ab"]
    close = close.join(ends[0], "a").join(ends[1], "b").select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"))
    links = _verified(equal.union(close), texts, scratch, "linked")
    scratch.reclaim()
    part = components(links, Scratch(spark)).withColumnRenamed("id", "v")
    order = spark.sparkContext.broadcast(_common(texts, distinct.count()))
    row_ddl = "key long, v long, n int, i int, root long"
    row_schema = arrow_schema(row_ddl)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, root = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, len(v), 256):
                out = []
                for k in range(at, min(at + 256, len(v))):
                    s = shingle_set(batch.column(1)[k].as_py())
                    p = prefix(s, *order.value)
                    out.append((p.view(np.int64), np.full(len(p), v[k]), np.full(len(p), len(s), np.int32), np.arange(len(p), dtype=np.int32), np.full(len(p), root[k])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=row_schema)

    def pairs(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """(key, a, b, n, m, i): the pairs of a list that are still apart, or where it is long its rows, with a = b."""
        k, v, size, at, root = cols
        if (root == root[0]).all():
            return
        if len(v) > MANY:
            yield [k, v, v, size, size, at]
            return
        p, q = _pairs(len(v))
        good = (root[p] != root[q]) & may_be_near(size[p], at[p], size[q], at[q])
        p, q = p[good], q[good]
        p, q = np.where(v[p] > v[q], q, p), np.where(v[p] > v[q], p, q)
        yield [np.zeros(len(p), np.int64), v[p], v[q], size[p], size[q], np.zeros(len(p), np.int32)]

    def closest(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """(a, b) of a long list's forest."""
        _, v, size, at, root, bits, side, cross = cols
        for x, y in _LongList(v, size, at, root, bits, side, bool(cross[0])).forest():
            yield [np.minimum(v[x], v[y]), np.maximum(v[x], v[y])]

    def apart(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """(a, b, n, m) of all pairs that a long list leaves apart."""
        _, v, size, at, root, bits, side, cross = cols
        for x, y in _LongList(v, size, at, root, bits, side, bool(cross[0])).all():
            yield [np.minimum(v[x], v[y]), np.maximum(v[x], v[y]), size[x], size[y]]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(shingle_set(t.as_py())) for t in batch.column(1)], pa.binary())], names=["v", "bits"])

    rows = texts.join(part, "v", "left").select("v", "text", F.coalesce("root", "v").alias("root")).mapInArrow(deal, row_ddl)
    met = scratch.keep(_lists(rows, n, pairs, "key long, a long, b long, n int, m int, i int"), "met")
    scratch.reclaim()
    many = met.where("a = b").select("key", F.col("a").alias("v"), "n", "i")
    heavy = many.groupBy("v").agg(F.count("*").alias("h"))
    few = met.where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    few = few.join(heavy.select(F.col("v").alias("a"), F.col("h").alias("ha")), "a", "left").join(heavy.select(F.col("v").alias("b"), F.col("h").alias("hb")), "b", "left")
    # What two prefixes share and what may follow one of them bounds the overlap.
    few = few.where("9 * (c + least(coalesce(ha, 0), coalesce(hb, 0)) + (4 * greatest(n, m) + 4) div 5 - 1) >= 4 * (n + m)").select("a", "b")
    few = _verified(few, texts, scratch, "near")
    links = links.union(few)
    if not many.isEmpty():
        drawn = scratch.keep(texts.join(heavy.select("v"), "v", "left_semi").select("v", "text").mapInArrow(draw, "v long, bits binary"), "sketches", small=True)
        # A list of over BLOCK is dealt to several tasks by pairs of blocks.
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = many.join(many.groupBy("key").agg(F.count("*").alias("size")), "key").withColumn("side", F.pmod(F.xxhash64("v", F.lit(3)), blocks).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("key"), "v", "n", "i", "side", (F.col("side") != F.col("other")).alias("cross"))
        dealt = scratch.keep(dealt, "dealt_lists")

        def lists(links: DataFrame, of: Callable, ddl: str) -> DataFrame:
            part = components(links, Scratch(spark)).withColumnRenamed("id", "v")
            rows = dealt.join(part, "v", "left").join(drawn, "v")
            return _lists(rows.select("key", "v", "n", "i", F.coalesce("root", "v").alias("root"), "bits", "side", "cross"), n, of, ddl)

        tried = scratch.keep(lists(links, closest, "a long, b long").distinct(), "tried")
        links = links.union(_verified(tried, texts, scratch, "joined"))
        rest = lists(links, apart, "a long, b long, n int, m int")
        # Pairs that also share a shingle of a short list are decided above, so the long lists that a pair shares are all that its prefixes share.
        rest = rest.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
        rest = rest.where("9 * (c + (4 * greatest(n, m) + 4) div 5 - 1) >= 4 * (n + m)").select("a", "b").join(tried, ["a", "b"], "left_anti")
        links = links.union(_verified(rest, texts, scratch, "rest"))
    roots = components(links, scratch)
    named = distinct.join(roots.withColumnRenamed("id", "v"), "v", "left").select("x", "y", F.coalesce("root", "v").alias("root"))
    return names.join(named, ["x", "y"]).select(F.col("key").alias(key), "root")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest doc_id; of rows that share it, the first by content."""
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.bucketed(with_key(docs, scratch), "docs", "__key")
    steps = Scratch(docs.sparkSession)
    kept = scratch.keep(near_groups(keyed, "__key", scratch=steps).where(F.col("__key") == F.col("root")).select("__key"), "kept")
    steps.close()
    return keyed.join(kept, "__key", "left_semi").select(*docs.columns)

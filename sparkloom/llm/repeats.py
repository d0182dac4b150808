"""Repeated windows of tokens across documents: what both substring operators share.

A window is ``length`` consecutive tokens of one document; it is repeated if its tokens also start
earlier, by (document, position). Each window is named by the smallest hash among its runs of
``anchor`` tokens, the leftmost of equal ones, so equal windows share an anchor at the same offset, and neighbouring
windows mostly share theirs: a row stands for an anchor with all windows that it names (their tokens are its context).

1. Rows of equal contexts (an anchor and two more hashes, 192 bits) in one slice of documents meet before the shuffle: all but the earliest are
   repeated in full. So a text with many copies sends little.
2. The rest is dealt and sorted by anchor, once, and read in that order: later rows of equal contexts are repeated in
   full, anchors that occur once go, and where an anchor has several distinct contexts, these (one row each) are asked for.
3. Contexts that are asked for are cut from the texts and dealt by anchor to the operator's own structure, which finds
   equal windows among them. A group of over ``HOT`` contexts is split by more of the tokens around its anchor: windows that
   hold the anchor in their first half share at least half a window to its right, the others as much to its left, so each context goes to
   two groups, cut to the windows in question; then by halves of halves, until every group fits. Contexts that are equal once cut meet again.

What is shuffled is the texts once (kept in buckets, so later joins leave them where they are), one short row per few tens of tokens, and the contexts in
question. Every step is written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches, partitions

#: Contexts in a group that one task takes whole.
HOT = 4_000
CHUNK = 1 << 20
#: Bytes of contexts that one in-memory structure is built over at most (beyond that only for one group's).
ROOM = 1 << 19
#: Bytes and documents of a slice, in which equal contexts meet before the shuffle.
SLICE_BYTES, SLICE_DOCS = 4 << 20, 512
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sums, inverse powers): ``(s[b] - s[a]) * down[a]`` is a hash of the tokens from a to b, wherever they stand."""
    up, down = _power(len(x) + 1)
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=s[1:])
    return s, down


def anchors(a: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(key, two context hashes, first window, anchor's offset in it, number of windows) of a document's tokens ``a`` (64-bit hashes)."""
    parts = []
    for lo in range(0, max(0, len(a) - length + 1), CHUNK):
        x = a[lo : lo + CHUNK + length - 1]
        s, down = _sums(x)
        h = _mix((s[anchor:] - s[:-anchor]) * down[: len(x) - anchor + 1])
        m = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        size, width = 1, length - anchor + 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if width > size:
            m = np.minimum(m[: size - width], m[width - size :])
        pos = (m & np.uint64(0xFFFFFF)).astype(np.int64)
        st = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        en = np.append(st[1:], len(pos))
        p = pos[st]
        shape = (p - st).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (en - st).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        t, _ = _sums(_mix(x + np.uint64(0x2545F4914F6CDD1D)))
        whole, more = (_mix((v[en - 1 + length] - v[st]) * down[st] + shape) for v in (s, t))
        parts.append((h[p], whole, more, st + lo, p - st, en - st))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def numbered(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, text): uid is doc_id where that is a key; else numbers in the order of (doc_id, text hash), nulls first."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    odd = src.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return src.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    hashed = src.withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))
    ids = hashed.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct().orderBy(F.asc_nulls_first("d"), "t")
    known = scratch.keep(ids.withColumn("uid", F.monotonically_increasing_id()), "ids")
    return hashed.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("uid", "doc_id", "text")


def _met(key: np.ndarray, whole: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which rows have the context of the row before them."""
    return np.concatenate([[False], (key[1:] == key[:-1]) & (whole[1:] == whole[:-1]) & (more[1:] == more[:-1])]) if len(key) else np.zeros(0, bool)


def spans(
    rows: DataFrame, scratch: Scratch, length: int, anchor: int, tokens: Callable[[str | None], np.ndarray], dtype: str, spread: Callable[[np.ndarray], np.ndarray],
    same: Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]],
) -> DataFrame:
    """(uid, spans): the token spans of repeated windows of each row of ``rows`` (uid, text; best bucketed by uid) that has any.

    ``tokens`` gives a text's tokens as ``dtype``; ``spread`` makes 64-bit hashes of them; ``same`` gets contexts with their anchors'
    keys, offsets and numbers of windows, and gives for each class of equal windows arrays (class, context, window in it).
    """
    spark = rows.sparkSession
    n = partitions(spark)
    bound_batches(spark)
    # A row with off < 0 is a span that is known to be repeated, from st to n.
    seen, found_ddl, cut_ddl = "key long, whole long, more long, uid long, st int, off int, n int", "key long, uid long, st int, off int, n int", "key long, uid long, st int, off int, n int, context binary"
    seen_schema, found_schema, cut_schema, span_schema = map(arrow_schema, (seen, found_ddl, cut_ddl, "uid long, a int, b int"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            part = size // SLICE_BYTES + np.arange(len(size)) // SLICE_DOCS
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist() if len(part) else []
            uids = batch.column(0).to_numpy()
            for lo, hi in zip(edge, edge[1:]):
                cols: list[tuple[np.ndarray, ...]] = []
                for i in range(lo, hi):
                    got = anchors(spread(tokens(batch.column(1)[i].as_py())), length, anchor)
                    cols.append((*got, np.full(len(got[0]), uids[i])))
                key, whole, more, st, off, k, uid = (np.concatenate(c) for c in zip(*cols))
                order = np.lexsort((st, uid, more, whole, key))
                again = _met(key[order], whole[order], more[order])
                keep, copy = order[~again], order[again]
                copy = copy[np.lexsort((st[copy], uid[copy]))]
                u, a, b = uid[copy], st[copy], st[copy] + k[copy] - 1 + length
                new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (a[1:] > b[:-1])])) if len(u) else np.zeros(0, np.int64)
                last = np.append(new[1:], len(u)) - 1 if len(u) else new
                u, a, b = u[new], a[new], b[last]
                none = np.zeros(len(u), np.int64)
                out = [(key[keep].view(np.int64), _mix(u.astype(np.uint64) + np.uint64(_BASE)).view(np.int64)), (whole[keep].view(np.int64), none), (more[keep].view(np.int64), none), (uid[keep], u), (st[keep], a), (off[keep], none - 1), (k[keep], b)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(out, seen_schema)], schema=seen_schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and context: spans of later rows of a context, and the first row of each context of a key that has several."""
        before, held = None, None
        for batch in batches:
            key, whole, more, uid, st, off, k = cols = [c.to_numpy() for c in batch.columns]
            known = off < 0
            out = [(key[known], uid[known], st[known], off[known], k[known])]
            key, whole, more, uid, st, off, k = (c[~known] for c in cols)
            if len(key):
                again = _met(key, whole, more)
                other = np.concatenate([[True], key[1:] != key[:-1]])
                if before is not None:
                    again[0], other[0] = (key[0], whole[0], more[0]) == before, key[0] != before[0]
                before = key[-1], whole[-1], more[-1]
                out.append((key[again], uid[again], st[again], np.full(again.sum(), -1, np.int32), st[again] + k[again] - 1 + length))
                first = np.flatnonzero(~again)
                if len(first):
                    lone = other[first]  # the first context of its key, asked for if another one follows
                    if held is not None and not lone[0]:
                        out.append(held)
                    asked = first[~lone | np.append(~lone[1:], False)]
                    out.append((key[asked], uid[asked], st[asked], off[asked], k[asked]))
                    at = first[-1:]
                    held = (key[at], uid[at], st[at], off[at], k[at]) if lone[-1] else None
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(zip(*out), found_schema)], schema=found_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, uid = tokens(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()
                out = [(x["key"], uid, x["st"], x["off"], x["n"], t[x["st"] : x["st"] + x["n"] - 1 + length].tobytes()) for x in batch.column(2)[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), cut_schema)], schema=cut_schema)

    def split(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Contexts cut to the windows that hold the anchor at ``width`` + 1 neighbouring offsets, keyed by the tokens around it that all of these windows hold."""
        room = length - anchor

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, uid, st, off, k, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                    t = np.frombuffer(ctx, dtype)
                    s, down = _sums(spread(t))
                    for c in range((off - k + 1) // (width + 1), off // (width + 1) + 1):
                        a, b = c * (width + 1), min(c * (width + 1) + width, room)
                        i, j = off - min(b, off), off - max(a, off - k + 1)
                        seed = np.array([key ^ (c + 1) * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF], np.int64).view(np.uint64)
                        h = _mix((s[off + length - b] - s[off - a]) * down[off - a : off - a + 1] + _mix(seed))
                        out.append((int(h.view(np.int64)[0]), uid, st + i, off - i, j - i + 1, t[i : j + length].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), cut_schema)], schema=cut_schema)

        return run

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own, size = None, [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    held += own
                    key, own = row[0], []
                    if size > ROOM:
                        yield flush(held)
                        held, size = [], 0
                own.append(row)
                size += len(row[5])
        if held or own:
            yield flush(held + own)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        keys, uid, st, off, k = (np.array(c) for c in list(zip(*rows))[:5])
        found = []
        for cls, own, at in same([np.frombuffer(r[5], dtype) for r in rows], keys, off, k):
            start = st[own] + at
            order = np.lexsort((start, uid[own], cls))
            cls, u, s = cls[order], uid[own][order], start[order]
            later = np.concatenate([[False], cls[1:] == cls[:-1]]) if len(cls) else np.zeros(0, bool)
            found.append((u[later], s[later]))
        return merged(found)

    def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Runs of consecutive windows as spans."""
        u = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        s = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((s, u))
        u, s = u[order], s[order]
        new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (s[1:] > s[:-1] + 1)])) if len(u) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(u)) - 1 if len(u) else new
        return pa.RecordBatch.from_arrays([pa.array(u[new].astype(np.int64)), pa.array(s[new].astype(np.int32)), pa.array((s[last] + length).astype(np.int32))], schema=span_schema)

    own = rows.select("uid", "text")
    found = own.mapInArrow(find, seen).repartition(n, "key").sortWithinPartitions("key", "whole", "more", "uid", "st").mapInArrow(scan, found_ddl)
    found = scratch.keep(found, "found")
    scratch.reclaim()
    asked = found.where("off >= 0").groupBy("uid").agg(F.collect_list(F.struct("key", "st", "off", "n")).alias("xs"))  # a document's own anchors
    rest = scratch.keep(own.join(asked, "uid").mapInArrow(cut, cut_ddl), "contexts")
    scratch.reclaim()
    parts = [found.where("off < 0").select("uid", F.col("st").alias("a"), F.col("n").alias("b"))]
    step, width = 0, length - anchor
    while True:
        large = scratch.keep(rest.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("key"), f"large{step}", small=True)
        if large.isEmpty():
            break
        parts.append(rest.join(large, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key").mapInArrow(match, "uid long, a int, b int"))
        step, width = step + 1, width // 2
        cuts = scratch.keep(rest.join(large, "key", "left_semi").mapInArrow(split(width), cut_ddl).withColumn("w", F.xxhash64("context")), f"split{step}")
        # What was cut away may have been all that told contexts apart. At a width of 0 a context is a window, and all of a group are equal.
        first = cuts.groupBy("key", "off", "n", "w").agg(F.min(F.struct("uid", "st")).alias("first"))
        again = (F.col("uid") != F.col("first.uid")) | (F.col("st") != F.col("first.st"))
        met = scratch.keep(cuts.join(first, ["key", "off", "n", "w"]).withColumn("again", again), f"met{step}")
        parts.append(met.where("again").select("uid", F.col("st").alias("a"), (F.col("st") + F.col("n") - 1 + length).cast("int").alias("b")))
        rest = met.where("NOT again").select("key", "uid", "st", "off", "n", "context")
    parts.append(rest.repartition(n, "key").sortWithinPartitions("key").mapInArrow(match, "uid long, a int, b int"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    out = scratch.keep(every.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    scratch.drop("found", "contexts", *(f"{name}{k}" for k in range(1, step + 1) for name in ("split", "met")))
    scratch.reclaim()
    return out


def covered(n: int, found: list[dict] | None) -> np.ndarray:
    """Mask of the ``n`` tokens that some span covers."""
    edge = np.zeros(n + 1, np.int32)
    for x in found or ():
        edge[x["a"]] += 1
        edge[x["b"]] -= 1
    return np.cumsum(edge[:n]) > 0

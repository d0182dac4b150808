"""Substring dedup of bytes: intervals of a Burrows-Wheeler transform, widened backward.

Contexts of anchors (see ``repeats``) are joined with separators and their suffixes sorted. Starting
from the interval of all suffixes, breadth-first backward extension finds the intervals of all strings by
increasing length: extending each interval of length l by each byte before it gives intervals of length l + 1,
and the first time that one ends at a place in the order, l is the common prefix of the suffixes on
either side. Extension stops at the minimum length, so what stays undecided shares at least that much:
runs of such suffixes are the repeated strings.

Defined results: null and empty texts lose nothing, and neither do texts below the minimum length; very long texts are read in chunks
and compared whole; identical rows share one result; rows that share a doc_id but not the text are ordered by text hash;
a null doc_id comes first; an empty table gives no row; extra columns are ignored. Equal contexts are recognised by 192 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches
from .repeats import _mix, covered, numbered, spans

LENGTH = 100
ANCHOR = 24
#: A fixed 64-bit code of each byte.
_CODE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s`` (small non-negative integers) sorted by at least ``depth`` symbols from there; beyond the end counts lowest."""
    n = len(s)
    word = np.zeros(n + 8, np.uint64)
    word[:n] = s.astype(np.uint64) + np.uint64(1)
    r = np.zeros(n, np.uint64)
    for k in range(7):  # seven 9-bit symbols at once
        r = (r << np.uint64(9)) | word[k : k + n]
    size = 7
    while True:
        order = np.argsort(r)
        if size >= depth:
            return order
        v = r[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        after[: max(0, n - size)] = rank[size:]
        r = (rank << np.uint64(32)) | after
        size *= 2


def long_repeats(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, mask): the mask marks places whose suffix shares at least ``least`` symbols with the one before."""
    n = len(s)
    order = suffix_order(s, least)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # Where each suffix goes when its preceding symbol is put in front: the last-to-first mapping of the transform.
    before = order - 1
    before[before < 0] = n - 1
    back = place[before]
    front = s[order]  # first symbol of each suffix in order
    decided = np.zeros(n + 1, bool)
    decided[0] = decided[n] = True
    lo, hi = np.array([0]), np.array([n])
    owner = np.full(n, -1, np.int64)
    for _ in range(least):
        if not len(lo):
            break
        size = hi - lo
        ids = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        to = back[at]
        if len(to) * 8 > n:
            owner[to] = ids
            to = np.flatnonzero(owner >= 0)
            ids = owner[to]
            owner[to] = -1
        else:
            by = np.argsort(to)
            to, ids = to[by], ids[by]
        # Places that come from one interval by one symbol are again an interval.
        cut = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (ids[1:] != ids[:-1]) | (front[to[1:]] != front[to[:-1]])])
        start = np.flatnonzero(cut)
        a, b = to[start], to[np.append(start[1:], len(to)) - 1] + 1
        new = ~decided[b]
        new |= b == n  # the last interval of a length has no place after it, but others before it in the next one may
        decided[b] = True
        lo, hi = a[new], b[new]
    return order, ~decided[:n]


def equal_windows(texts: list[np.ndarray], keys: np.ndarray, off: np.ndarray, k: np.ndarray, least: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes of equal windows: (class, context, window) arrays."""
    lens = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    s = np.zeros(int(lens.sum()) + len(texts), np.uint16)
    for a, t in zip(at, texts):
        s[a : a + len(t)] = t
        s[a : a + len(t)] += 1
    order, deep = long_repeats(s, least)
    own = np.repeat(np.arange(len(texts)), lens + 1)
    inside = np.arange(len(s)) - at[own]
    cls = np.cumsum(~deep)
    both = deep | np.append(deep[1:], False)
    keep = both & (inside[order] < k[own[order]])
    return [(cls[keep], own[order][keep], inside[order][keep])]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def remove(docs: DataFrame, least: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, kept (binary)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.bucketed(numbered(docs, scratch, id_col, text_col), "texts", "uid")
    anchor = max(1, least // 4 - 1)
    found = spans(rows, scratch, least, anchor, _bytes, "u1", lambda t: _CODE[t], lambda *a: equal_windows(*a, least=least))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                t = _bytes(batch.column(1)[i].as_py())
                got = batch.column(2)[i].as_py()
                if got:
                    gone = covered(len(t), got)
                    kept, edges = t[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, edges = t.tobytes(), 0
                out.append((batch.column(0)[i].as_py(), len(t), len(t) - len(kept), edges, hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_text else ()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    bound_batches(spark)
    return rows.join(found, "uid", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)

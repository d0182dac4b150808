"""Substring dedup of words: suffix trees over groups of suffixes that share a prefix.

Suffixes are grouped by anchors (see ``repeats``), runs of ``ANCHOR`` words that equal windows share. A group too large for memory
is split by prefixes: each suffix by its words up to the anchor's end, so the prefixes have from ``ANCHOR`` to all words of a window, then by longer ones.
A group's suffix tree is its suffixes in order with the number of words that neighbours share: an internal node is a
run of neighbours that share at least its depth. The deep ones, of a window's words or more, are the repeats.

Defined results: null and blank texts have no words; texts of fewer words than a window lose nothing; very long texts are
compared whole; identical rows share one result; rows that share a doc_id but not the text are ordered by text hash; a null
doc_id comes first; an empty table gives no row; extra columns are ignored. Words and equal contexts are recognised by 64 and 192 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches, with_key
from .repeats import covered, numbered, spans

LENGTH = 20
ANCHOR = 7


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(text: str | None) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in words(text)], np.uint64)


def tree(s: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the order of their suffixes, words shared with the one before), both up to ``depth`` words.

    Runs of 1, 2, 4, ... words get ranks in order, each from two runs of half the size, so a suffix is compared by two ranks and shared words are counted by halving.
    """
    n, size = len(s), 1
    ranks = [(1, np.unique(s, return_inverse=True)[1].astype(np.int64))]
    while size * 2 <= depth:
        r = ranks[-1][1]
        after = np.full(n, -1, np.int64)
        after[: n - size] = r[size:]
        size *= 2
        ranks.append((size, np.unique(r * np.int64(n + 1) + after, return_inverse=True)[1]))
    r = ranks[-1][1]
    starts = starts[np.lexsort((r[np.minimum(starts + depth - size, n - 1)], r[starts]))]
    shared = np.zeros(len(starts), np.int64)
    for size, r in reversed(ranks):
        a, b = starts[1:] + shared[1:], starts[:-1] + shared[1:]
        fits = (shared[1:] + size <= depth) & (a < n) & (b < n)
        shared[1:] += size * (fits & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]))
    return starts, shared


def deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of the internal node of at least this depth that each suffix in order is below, -1 where there is none."""
    deep = shared >= depth
    below = deep | np.append(deep[1:], False)
    return np.where(below, np.cumsum(~deep), -1)


def equal_windows(texts: list[np.ndarray], keys: np.ndarray, off: np.ndarray, k: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes of equal windows: (class, context, window) arrays."""
    lens = np.array([len(t) for t in texts])
    at = np.cumsum(lens) - lens
    own = np.repeat(np.arange(len(texts)), k)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
    order, shared = tree(np.concatenate(texts), at[own] + inside, length)
    node = deep_nodes(shared, length)
    order, node = order[node >= 0], node[node >= 0]
    own = np.searchsorted(at, order, side="right") - 1
    return [(node, own, order - at[own])]


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession)
    rows = numbered(docs, scratch, id_col, text_col).select(F.col("uid").alias("__uid"), F.col("text").alias("__text"), "doc_id")
    return _removed(rows, scratch, length, ["doc_id"], ("n_words", "n_removed", "kept_sha256"))


def _removed(rows: DataFrame, scratch: Scratch, length: int, carried: list[str], names: tuple[str, str, str], kept_text: str | None = None) -> DataFrame:
    """Columns ``carried`` of ``rows`` (__uid, __text and others) with the figures and, if named, the kept text."""
    anchor = max(1, length * ANCHOR // LENGTH)
    rows = scratch.bucketed(rows, "texts", "__uid")
    own = rows.select(F.col("__uid").alias("uid"), F.col("__text").alias("text"))
    found = spans(own, scratch, length, anchor, _hashes, "u8", lambda t: t, lambda *a: equal_windows(*a, length=length))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = f"`{names[0]}` long, `{names[1]}` long, `{names[2]}` string" + (f", `{kept_text}` string" if kept_text else "")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), made])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(0)[i].as_py()
                w, got = words(text), batch.column(1)[i].as_py()
                if got:
                    gone = covered(len(w), got)
                    kept = [x for x, g in zip(w, gone.tolist()) if not g]
                else:
                    kept = w
                joined = b" ".join(kept)
                # A text that loses nothing stays as it is, white space included.
                whole = (text if not got else joined.decode("utf-8", "surrogatepass"),) if kept_text else ()
                out.append((len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest(), *whole))
            if out:
                cols = [c.cast(f.type) for c, f in zip(batch.columns[2:], arrow)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(list(c), f.type) for c, f in zip(zip(*out), list(arrow)[len(cols) :])], schema=arrow)

    bound_batches(rows.sparkSession)
    joined = rows.join(found.select(F.col("uid").alias("__uid"), F.col("spans").alias("__spans")), "__uid", "left")
    return joined.select("__text", "__spans", *(F.col(f"`{c}`") for c in carried)).mapInArrow(run, schema)


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a document of which nothing is left goes, n_chars follows."""
    scratch, carried = Scratch(docs.sparkSession), [c for c in docs.columns if c != "text"]
    rows = with_key(docs, scratch, key="__uid").withColumnRenamed("text", "__text")
    cut = _removed(rows, scratch, length, carried, ("__words", "__removed", "__sha"), "text")
    cut = cut.where((F.col("__words") > F.col("__removed")) | (F.col("__removed") == 0))
    if "n_chars" in carried:
        cut = cut.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)

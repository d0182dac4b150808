"""Token-ID / binary output: id payloads in shards, each with a minimal perfect hash index.

``write`` deals documents by ranges of doc_id, encodes each range in order with the tokenizers library
and writes shards: a shard is one Parquet row that holds the raw little-endian ids of up to
``SHARD_BYTES``, its documents' ids in order, and a minimal perfect hash over the keys
(hash-and-displace: a displacement for each bucket sends its keys to free slots). A slot stores its
key's fingerprint, offset and length, so a keyed read is one hash, one displacement, one comparison and
one slice. Spark's own writer commits shards, so a lost executor's attempt leaves nothing behind, and
any store that Spark writes will do.

The only shuffle is the one by range that ascending order asks for. First positions need the ids of
all ranges before, which is a running sum over one number per range.

Defined results: a null text has no ids but the end id; a null doc_id comes before all others; rows that share a
doc_id are ordered by their text's hash and keyed by (doc_id, ordinal in the shard); an empty table gives
no shard; extra columns are ignored; a document over ``SHARD_BYTES`` gets a shard of its own.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches, partitions

SHARD_BYTES = 1 << 20
SHARD_DOCS = 4096
#: Pieces that a generation of a worker's cache holds, of which there are two; at about 200 bytes each this bounds it.
CACHE = 450_000
#: Bytes of text that are encoded at once; a longer text is cut at white space, so only a longer word is more.
SLICE_BYTES = 4 << 20
SHARD_SCHEMA = (
    "part int, shard int, first_doc long, last_doc long, n_nulls long, n_docs long, n_ids long, first_id long, width int, "
    "keys array<long>, ordinals binary, disp binary, fingerprints binary, offsets binary, lengths binary, payload binary"
)

# -- minimal perfect hash -----------------------------------------------------


def key_hash(doc_id: int | None, ordinal: int) -> tuple[int, int, int, int]:
    """Bucket hash, two halves of the slot hash, and fingerprint of a key."""
    key = struct.pack("<?qI", doc_id is None, doc_id or 0, ordinal)
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2)
    return a & 0xFFFFFFFF, b & 0xFFFFFFFF, b >> 32, a >> 32


def _place(h: tuple[int, int, int, int], d: int, n: int) -> int:
    x = ((h[1] << 32 | h[2]) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x >> 32) % n


def _slot(h: tuple[int, int, int, int], disp, n: int) -> int:
    d = int(disp[h[0] % len(disp)])
    return -d - 1 if d < 0 else _place(h, d, n)


def build(hashes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Displacements that send each of n distinct keys to its own slot below n; a bucket of one key stores its slot."""
    n = len(hashes)
    m = max(1, (n + 3) // 4)
    buckets: list[list[int]] = [[] for _ in range(m)]
    for i, h in enumerate(hashes):
        buckets[h[0] % m].append(i)
    disp, taken, at = np.zeros(m, np.int32), bytearray(n), 0
    for b in sorted(range(m), key=lambda b: -len(buckets[b])):
        own = buckets[b]
        if len(own) < 2:
            if own:
                at = taken.index(0, at)
                disp[b], taken[at] = -at - 1, 1
            continue
        for d in range(1 << 31):
            slots = [_place(hashes[i], d, n) for i in own]
            if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                break
            if d > 1 << 20:
                raise ValueError("two keys share a hash")
        disp[b] = d
        for s in slots:
            taken[s] = 1
    return disp


class Shard:
    """Keyed access over one shard row."""

    def __init__(self, row: dict):
        self.n, self.width, self.keys = row["n_docs"], row["width"], row["keys"]
        self.ordinals = np.frombuffer(row["ordinals"], "<u4")
        self.disp = np.frombuffer(row["disp"], "<i4")
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.offsets = np.frombuffer(row["offsets"], "<u8")
        self.lengths = np.frombuffer(row["lengths"], "<u8")
        self.payload = memoryview(row["payload"])

    def find(self, doc_id: int | None, ordinal: int = 0) -> tuple[int, np.ndarray] | None:
        """(offset, ids) of a key, both counted in ids, or None where the stored fingerprint differs."""
        h = key_hash(doc_id, ordinal)
        s = _slot(h, self.disp, self.n)
        if not 0 <= s < self.n or self.prints[s] != h[3]:
            return None
        at, k = int(self.offsets[s]), int(self.lengths[s])
        return at, np.frombuffer(self.payload[at * self.width : (at + k) * self.width], f"<u{self.width}")


# -- encoding -----------------------------------------------------------------

GAP = re.compile(r"[\x20\x09-\x0D]")
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: First code point beyond what is split and lower-cased here.
EDGE = 0x250


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each code point up to ``EDGE``, which stands for all beyond. ``ODD`` ones leave their word to the library."""
    kind, low = np.full(EDGE + 1, ODD, np.uint8), np.arange(EDGE + 1, dtype="<u4")
    for c in range(EDGE):
        lower = chr(c).lower()
        # White space beyond ASCII, and what is longer or further on in lower case.
        if len(lower) == 1 and ord(lower) < EDGE and not 0x1C <= c <= 0x1F and c not in (0x85, 0xA0):
            kind[c] = SPACE if c == 32 or 9 <= c <= 13 else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(lower)[0], OTHER)
            low[c] = ord(lower)
    return kind, low


KIND, LOWER = _tables()


def split(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Pieces of all texts in order, which of them are whole words that only the library may split, and each text's first piece (and the end)."""
    joined = "\n".join(texts) + "\n\n\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    near = points.astype(np.intp)
    kind, low = KIND.take(near, mode="clip"), LOWER.take(near, mode="clip")
    del near  # the largest of these arrays
    word = kind != SPACE
    start = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == NUMBER
    start &= word
    if "'" in joined:
        at = np.flatnonzero(points == ord("'"))
        at = at[start[at]]
        a, b = low[at + 1], low[at + 2]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[at[two | three] + 1] = False
        ends = np.concatenate([at[two] + 2, at[three] + 3])
        start[ends] = word[ends]
    odd = kind == ODD
    if "<|" in joined:
        odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
    if odd.any():
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        number = np.cumsum(begin)
        whole = np.zeros(number[-1] + 1, bool)
        whole[number[odd]] = True
        odd = whole[number] & word
        start, low = np.where(odd, begin, start), np.where(odd, points, low)
    at, kept = np.flatnonzero(start), low[word]
    del joined, points, low, kind
    data = kept.tobytes().decode("utf-32-le").encode()
    offsets = np.append(np.flatnonzero(start[word]), len(kept)).astype(np.int64, copy=False)
    if len(data) > len(kept):
        size = np.ones(len(kept), np.uint8)
        for c in (0x80, 0x800, 0x10000):
            size += kept >= c
        offsets = np.append(0, np.cumsum(size, dtype=np.int64))[offsets]
    first = np.searchsorted(at, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), odd[at], first


def stretches(text: str) -> Iterator[str]:
    """A text cut at white space, so that however long it is, little more than a slice is split at once."""
    at = 0
    while len(text) - at > SLICE_BYTES and (gap := GAP.search(text, at + SLICE_BYTES)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


class WordEncoder:
    """Encodes many texts at once, piece by piece with a cache, for tokenizers whose pieces never span white space.

    The library's result for a text is the concatenation of its results for the words, as its
    normaliser only composes, lower-cases and collapses white space, and its split drops white space.
    Pieces are numbered before they are looked up, so Python sees each of a slice's different pieces once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.lib = Tokenizer.from_file(path)
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in plain]
        self.symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        named = {k: spec[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if spec.get(k) is not None}
        # The model's own cache is off: what it would remember is remembered here, and filling it costs as much as merging.
        self.model = BPE(spec["vocab"], merges, cache_capacity=0, **named)
        self.known, self.old = {}, {}

    def pack(self, ids: list[int]) -> bytes:
        a = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def piece(self, piece: str) -> bytes:
        # Letters of ASCII stand for themselves in the model's alphabet.
        spelt = piece if piece.isascii() and piece.isalpha() else "".join(map(self.symbols.__getitem__, piece.encode()))
        return self.pack([t.id for t in self.model.tokenize(spelt)])

    def word(self, word: str) -> bytes:
        return self.pack(self.lib.encode(word, add_special_tokens=False).ids)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        pieces, whole, first = split(texts)
        coded = pieces.dictionary_encode()
        unlike = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        by_library = set(coded.indices.to_numpy()[whole].tolist()) if whole.any() else ()
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        ids = list(map(known.get, unlike))
        for i, got in enumerate(ids):
            if got is None:
                p = unlike[i]
                got = old.get(p)
                if got is None:
                    got = self.word(p) if i in by_library else self.piece(p)
                ids[i] = known[p] = got
        out = pa.array(ids, pa.large_binary()).take(coded.indices)
        if not len(out):
            return [b""] * len(texts)
        at = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, 8 * out.offset)[first].tolist()
        data = memoryview(out.buffers()[2]) if at[-1] else b""
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_all([t])[0] for t in stretches(text))


class LibraryEncoder:
    """Encodes whole texts with the library, for tokenizers of any other kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4

    pack = WordEncoder.pack

    def encode(self, text: str) -> bytes:
        return self.pack(self.lib.encode(text, add_special_tokens=False).ids)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


#: Normaliser and split of the tokenizers that ``WordEncoder`` is right for, fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def word_by_word(path: str) -> bool:
    """Whether the tokenizer file's rules are those that ``WordEncoder`` has."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    last = {k: v for k, v in split[-1].items() if k in ("type", "add_prefix_space", "use_regex")}
    return (
        spec.get("normalizer") == NORMALIZER and len(split) == 2 and split[0] == SPLIT and last == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
        and all(t["content"].startswith("<|") and not t["normalized"] for t in spec.get("added_tokens", []))
    )


@cache
def encoder(path: str) -> WordEncoder | LibraryEncoder:
    """One encoder for all tasks of a worker, so that they share its caches: word by word where the file's rules allow that, else the library's."""
    return WordEncoder(path) if word_by_word(path) else LibraryEncoder(path)


def encoded(batch: pa.RecordBatch, enc: WordEncoder | LibraryEncoder) -> Iterator[tuple[int | None, bytes, int]]:
    """doc_id, packed ids and part of each row; texts are encoded a slice at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        until = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
        rows = batch.slice(at, max(1, until - at))
        texts = [t or "" for t in rows.column("text").to_pylist()]
        ids = enc.encode_all(texts) if len(texts) > 1 else [enc.encode(texts[0])]
        yield from zip(rows.column("doc_id").to_pylist(), ids, rows.column("part").to_pylist())
        at += len(texts)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write shards in ascending doc_id order to ``path``."""
    spark = docs.sparkSession
    bound_batches(spark)
    schema = arrow_schema(SHARD_SCHEMA)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = src.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = enc.pack([end_id] if end_id is not None else [])
        keys, ordinals, pieces, size, shard, first, part = [], [], [], 0, 0, 0, 0

        def flush():
            nonlocal keys, ordinals, pieces, size, shard, first
            hashes = [key_hash(k, o) for k, o in zip(keys, ordinals)]
            disp = build(hashes)
            n = len(keys)
            prints, offsets, lengths, at = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8"), 0
            for h, p in zip(hashes, pieces):
                s, k = _slot(h, disp, n), len(p) // enc.width
                prints[s], offsets[s], lengths[s] = h[3], at, k
                at += k
            known = [k for k in keys if k is not None]
            row = [part, shard, min(known, default=None), max(known, default=None), n - len(known), n, at, first, enc.width, keys, np.array(ordinals, "<u4").tobytes(), disp.astype("<i4").tobytes(), prints.tobytes(), offsets.tobytes(), lengths.tobytes(), b"".join(pieces)]
            first, shard, keys, ordinals, pieces, size = first + at, shard + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, text, part in encoded(batch, enc):
                p = text + end
                if keys and (size + len(p) > SHARD_BYTES or len(keys) >= SHARD_DOCS):
                    yield flush()
                ordinals.append(ordinals[-1] + 1 if keys and keys[-1] == doc else 0)
                keys.append(doc)
                pieces.append(p)
                size += len(p)
        if keys:
            yield flush()

    dealt.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards at ``path``, each found through its shard's index.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), part, shard.
    """
    bound_batches(spark)
    shards = spark.read.parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so the window has as many rows as there are partitions.
    before = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    schema = arrow_schema("doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                shard, out = Shard(row), []
                for doc, o in zip(shard.keys, shard.ordinals):
                    found = shard.find(doc, int(o))
                    if found is None:
                        raise ValueError(f"shard {row['part']}/{row['shard']} has no entry of its document {doc}")
                    out.append((doc, row["before"] + row["first_id"] + found[0], len(found[1]), zlib.crc32(found[1].astype("<u4").tobytes()), row["part"], row["shard"]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return shards.join(F.broadcast(before), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int")


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """Ids of the asked documents (a caller's list, so of bounded size), null among them if asked: shards whose range holds none are passed over by the scan."""
    bound_batches(spark)
    want = sorted({d for d in doc_ids if d is not None})
    shards, may = spark.read.parquet(path), F.lit(False)
    # Ranges that a scan can test against what Parquet knows of a row group or page; neighbours share one where there are many.
    step = max(1, -(-len(want) // 64))
    for at in range(0, len(want), step):
        may = may | ((F.col("first_doc") <= want[min(at + step, len(want)) - 1]) & (F.col("last_doc") >= want[at]))
    if None in doc_ids:
        may = may | (F.col("n_nulls") > 0)
    schema = arrow_schema("doc_id long, ids array<int>")
    asked = [*want, *([None] if None in doc_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                shard, out = Shard(row), []
                for doc in asked:
                    if doc is not None and not (row["first_doc"] is not None and row["first_doc"] <= doc <= row["last_doc"]):
                        continue
                    o = 0
                    while (found := shard.find(doc, o)) is not None and o < shard.n:
                        out.append((doc, found[1].tolist()))
                        o += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return shards.where(may).mapInArrow(run, "doc_id long, ids array<int>")


def encode_index(docs: DataFrame, tokenizer: str, end_id: int | None = 1, path: str | None = None) -> DataFrame:
    """``write`` then ``read``, in a scratch folder unless ``path`` says where the shards should stay."""
    spark = docs.sparkSession
    path = path or Scratch(spark).path("shards")
    write(docs, path, tokenizer, end_id)
    return read(spark, path)

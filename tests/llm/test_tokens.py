"""Token operators against the libraries themselves, on planted and random texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import byte_bpe, token_index

TEXTS = [
    "", " ", "  ", "\n", "a", " a", "  a", "\n\n a", "it's we're they'll I'd", "''s x's'st 's  's\n's", "'sfoo 'refoo 'rx", "a1b2 ½ 12345  ",
    "tab\tx  \t y z 　q  r", "naïve Élan ÀÉÎ İstanbul ΣΑΣ ﬁ é Å", "!!'s ... 're--'ve", "日本語 テキスト 한국어", "😀 👍🏽 x",
    "<|endoftext|> a<|startoftext|>b", "x\x1cy \x1f z\x85w", "A" * 5000, "́x ́", "__a_b", "'t't't 'T 'S it'S", "a \n b \r\n c", "trail   ", " p ",
]
ALPHABET = list("aZ9'  \n\tsetvrmld.!-_é 　½ß漢😀́İ\x1c\x85")


def texts():
    rnd = random.Random(5)
    return TEXTS + ["".join(rnd.choices(ALPHABET, k=rnd.randrange(1, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Bpe(P.path("byte_bpe_50k.tiktoken"))


def test_byte_bpe_is_the_library(bpe):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    all_texts = texts()
    for text, parts in zip(all_texts, bpe.encode_batch(all_texts)):
        ids = [i for p in parts for i in p[0]]
        assert ids == enc.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()
        assert [text.encode()[o:][: len(bpe.bytes[i])] for o, i in zip(bpe.offsets(ids), ids)] == [bpe.bytes[i] for i in ids]


def test_every_code_point_has_the_library_class(bpe):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wrong = []
    for lo in range(0, 0x30000, 0x1000):
        text = "".join(f"a{chr(c)}1" for c in range(lo, lo + 0x1000) if not 0xD800 <= c < 0xE000)
        if bpe.encode(text) != enc.encode_ordinary(text):
            wrong += [c for c in range(lo, lo + 0x1000) if not 0xD800 <= c < 0xE000 and bpe.encode(f"a{chr(c)}1") != enc.encode_ordinary(f"a{chr(c)}1")]
    assert not wrong, [hex(c) for c in wrong[:20]]


def test_boundaries_do_not_depend_on_blocks():
    points = np.array([ord(c) for c in "it's  a\n\ntest 12 ''x" * 40] + [0x110000], np.uint32)
    assert all(np.array_equal(byte_bpe.boundaries(points, b), byte_bpe.boundaries(points, 7)) for b in (1, 2, 64, 4096))


def test_word_encoder_is_the_library():
    enc, lib = token_index.WordEncoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for t in texts():
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_slices_are_the_library(monkeypatch):
    rnd, lib = random.Random(6), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    # Every code point that is split here, and some beyond, within words and alone.
    points = [*range(1, 0x300), 0x345, 0x3A3, 0x1E96, 0x1680, 0x2028, 0x2C65, 0x212A, 0xFB01, 0x10400, 0x1F600]
    own = [f"{a}{chr(c)}{b}" for c in points for a, b in (("", ""), ("x", "Y"), ("'", "s"), ("1", "'RE"), ("<|", "|>"))]
    all_texts = texts() + own + ["'", "x'", "'r", "'l", "x'l", "'re'Ve'LL'd''d", "<", "|", "< |", "x<|endoftext|>'s <|y"]
    want = {t: lib.encode(t, add_special_tokens=False).ids for t in all_texts}
    enc = token_index.WordEncoder(P.path("word_bpe_49k.json"))
    for _ in range(3):
        rnd.shuffle(all_texts)
        at = 0
        while at < len(all_texts):
            some = all_texts[at : at + rnd.choice([1, 2, 3, 500])]
            for t, ids in zip(some, enc.encode_all(some), strict=True):
                assert np.frombuffer(ids, "<u2").tolist() == want[t], repr(t)
            at += len(some)
    monkeypatch.setattr(token_index, "SLICE_BYTES", 5)
    for t in texts()[:300]:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == want[t], repr(t)


def test_word_encoder_keeps_pieces_once_however_words_spell_them():
    enc = token_index.WordEncoder(P.path("word_bpe_49k.json"))
    held = lambda: sum(len(v) for v in vars(enc).values() if isinstance(v, dict))
    before, stems = held(), [a + b + c for a in "abcdefgh" for b in "aeiou" for c in "klmnopqr"]
    enc.encode(" ".join(f(s) + end for s in stems for f in (str, str.upper, str.title) for end in ("", ",", ".", "'s", "!", "?", "7")))
    # The stems and seven endings, but not the 21 words of each stem.
    assert held() - before <= len(stems) + 7


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 50, 4096):
        hashes = [token_index.key_hash(i * 7919, 0) for i in range(n)]
        disp = token_index.build(hashes)
        assert sorted(token_index._slot(h, disp, n) for h in hashes) == list(range(n))


def test_index_round_trip(spark, tmp_path):
    rows = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "x"), (3, "again", "x"), (None, "no id", "x"), (200, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    path = f"file://{tmp_path}/shards"
    got = token_index.encode_index(df, P.path("word_bpe_49k.json"), path=path).collect()
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    crc = lambda t: zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in got) == sorted((d if d is not None else -1, crc(t)) for d, t, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    found = token_index.lookup(spark, path, [3, 200, 999_999]).collect()
    assert sorted(r.doc_id for r in found) == [3, 3, 3, 200]


def test_other_tokenizers_are_left_to_the_library(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    assert token_index.word_by_word(P.path("word_bpe_49k.json")) and not token_index.word_by_word(path)
    enc, lib = token_index.encoder(path), Tokenizer.from_file(path)
    for t in texts()[:200]:
        assert np.frombuffer(enc.encode(t), f"<u{enc.width}").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_lookup_reads_the_shards_in_question(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_index, "SHARD_BYTES", 2000)
    path = f"file://{tmp_path}/shards"
    rows = [(i, f"text number {i} " * 20) for i in range(300)] + [(None, "one"), (None, "another"), (77, "again " * 3000)]
    token_index.write(spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    shards = spark.read.parquet(path)
    assert shards.where("n_docs > 1 AND octet_length(payload) > 2000").isEmpty() and shards.where("octet_length(payload) > 2000").count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = token_index.lookup(spark, path, [5, 77, None])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(first_doc,5)" in text and "GreaterThanOrEqual(last_doc,5)" in text and "GreaterThan(n_nulls,0)" in text
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids + [1]
    assert sorted((str(r.doc_id), r.ids) for r in plan.collect()) == sorted((str(d), ids(t)) for d, t in rows if d in (5, 77, None))
    assert token_index.lookup(spark, path, list(range(0, 300, 3))).count() == 100 and token_index.lookup(spark, path, []).count() == 0


def test_byte_bpe_query_is_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, "x") for i, t in enumerate(texts()[:400])] + [(5, None, "x"), (None, "no id", "x"), (7, "long " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want, at = [], {}
    for d, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        starts = np.cumsum([0, *[len(lib.decode_single_token_bytes(i)) for i in ids]])[:-1]
        at[str(d), sha(" ".join(map(str, ids)).encode())] = (ids, starts.tolist())
        want.append((str(d), len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), zlib.crc32(starts.astype("<i8").tobytes())))
    got = byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), keep_ids=False).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.offsets_crc32) for r in got) == sorted(want)
    for r in byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken")).collect():
        assert (r.ids, r.offsets) == at[str(r.doc_id), r.ids_sha256]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_index.encode_index(df, P.path("word_bpe_49k.json"), path=f"file://{tmp_path}/s").count() == 0
    assert byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken")).count() == 0

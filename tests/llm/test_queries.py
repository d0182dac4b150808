"""Corpus operators against brute force on small fixtures with nulls, ties, repeats and odd texts."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import cross_polytope, matroska, mixing, ppm_language, repeats, simhash, suffix_array, suffix_tree, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, spans int"


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeéß", k=rnd.randrange(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rnd.choices(vocab, k=k))
    passage, texts = prose(45), []
    for i in range(n):
        kind = i % 6
        if kind == 0 and texts:
            texts.append(rnd.choice(texts))
        elif kind == 1:
            texts.append(prose(10) + " " + passage + "\n" + prose(8))
        elif kind == 2 and texts:
            w = (rnd.choice(texts) or "x").split(" ")
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(rnd.choice([None, "", " ", "short", "ab " * 90, "x" * 300, passage]))
        else:
            texts.append(prose(rnd.randrange(1, 120)))
    return [(i * 2, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", "ü", None]), len(t or ""), "k", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def cut(rows, split, length):
    """(doc_id, tokens, mask of repeated) by brute force."""
    seen, out = set(), []
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        t = split(text or "")
        mask = [False] * len(t)
        for p in range(len(t) - length + 1):
            w = tuple(t[p : p + length])
            if w in seen:
                mask[p : p + length] = [True] * length
            seen.add(w)
        out.append((doc, t, mask))
    return out


def by_bytes(rows):
    want = set()
    for doc, t, mask in cut(rows, str.encode, 100):
        kept = bytes(b for b, m in zip(t, mask) if not m)
        want.add((doc, len(t), sum(mask), sum(m and not p for p, m in zip([False, *mask], mask)), hashlib.sha256(kept).hexdigest()))
    return want


def by_words(rows):
    return {(doc, len(t), sum(m), hashlib.sha256(" ".join(w for w, g in zip(t, m) if not g).encode()).hexdigest()) for doc, t, m in cut(rows, WORD.findall, 20)}


def test_suffix_array(docs, rows):
    assert {tuple(r) for r in suffix_array.remove(docs).collect()} == by_bytes(rows)


def test_suffix_tree(docs, rows):
    assert {tuple(r) for r in suffix_tree.remove(docs).collect()} == by_words(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_large_groups_are_split(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    assert {tuple(r) for r in suffix_array.remove(docs).collect()} == by_bytes(rows)
    assert {tuple(r) for r in suffix_tree.remove(docs).collect()} == by_words(rows)


def test_substrings_with_clashing_ids(spark):
    p = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, p), (1, p), (1, p), (1, "other " + p), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in suffix_tree.remove(df).collect())
    assert got == [(-1, 40, 0), (1, 40, 40), (1, 40, 40), (1, 41, 40), (2, 0, 0)]
    assert suffix_array.remove(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [64, 257])
def test_long_texts_are_read_in_chunks(docs, rows, monkeypatch, chunk):
    """Windows across the seams of chunks are found like any other."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    assert {tuple(r) for r in suffix_array.remove(docs).collect()} == by_bytes(rows)
    assert {tuple(r) for r in suffix_tree.remove(docs).collect()} == by_words(rows)


def test_subtrees_against_sorting():
    rnd = random.Random(2)
    for depth in (1, 2, 3, 5, 8, 20):
        for _ in range(20):
            s = [rnd.randrange(3) for _ in range(rnd.randrange(depth, 90))]
            starts = np.array(rnd.sample(range(len(s) - depth + 1), rnd.randrange(1, len(s) - depth + 2)))
            order, shared = suffix_tree.tree(np.array(s, np.uint64), starts, depth)
            own = [tuple(s[i : i + depth]) for i in order.tolist()]
            assert own == sorted(own) and sorted(order.tolist()) == sorted(starts.tolist())
            assert shared.tolist()[1:] == [len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))) for a, b in zip(own, own[1:])]
            node = suffix_tree.deep_nodes(shared, depth)
            for i, j in itertools.combinations(range(len(own)), 2):
                assert (own[i] == own[j]) == (node[i] == node[j] >= 0)


def test_intervals_against_sorting():
    rnd = random.Random(1)
    for least in (1, 2, 5, 9):
        for _ in range(30):
            s = np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 80))], np.uint16)
            order, deep = suffix_array.long_repeats(np.append(s, 9), least)
            t = np.append(s, 9).tolist()
            for i in range(1, len(t)):
                a, b = t[order[i - 1] :], t[order[i] :]
                lcp = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))))
                assert deep[i] == (lcp >= least)


def components(ids, link):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        if link(i, j):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("room,broadcast", [(32_768, 0), (1, 1 << 20), (3, 0)])
def test_simhash(docs, rows, monkeypatch, room, broadcast):
    monkeypatch.setattr(simhash, "ROOM", room)
    monkeypatch.setattr(simhash, "BROADCAST", broadcast)
    fp = {r[0]: fingerprint(r[1]) for r in rows}
    root = components(list(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    assert {tuple(r) for r in simhash.groups(docs).collect()} == {(i, f"{fp[i]:016x}", root[i]) for i in fp}


def test_bk_tree_finds_all():
    rnd = random.Random(2)
    values = list({rnd.getrandbits(10) for _ in range(300)})
    tree = simhash.BkTree(2)
    for i, x in enumerate(values):
        assert sorted(tree.add(x, every=True)) == [j for j in range(i) if (values[j] ^ x).bit_count() <= 2]


def test_bk_tree_passes_over_no_component():
    """Links that a tree gives while it grows, and what a packed one answers, connect what all pairs connect."""
    rnd = random.Random(4)
    for _ in range(6):
        base = [rnd.getrandbits(24) for _ in range(8)]
        values = list({b ^ (1 << rnd.randrange(24)) ^ (1 << rnd.randrange(24)) ^ (rnd.getrandbits(24) if rnd.random() < 0.2 else 0) for b in base for _ in range(40)})
        root = components(values, lambda x, y: (x ^ y).bit_count() <= 2)
        tree, a, b = simhash.grown(values, 2)
        assert all((x ^ y).bit_count() <= 2 for x, y in zip(a, b))
        linked = set(zip(a, b))
        assert components(values, lambda x, y: (x, y) in linked or (y, x) in linked) == root
        packed = simhash.BkTree.unpacked(tree.packed(), 2)
        for x in [rnd.choice(values) ^ (1 << rnd.randrange(24)) for _ in range(50)]:
            assert {root[packed.values[k]] for k in packed.near(x)} == {root[v] for v in values if (v ^ x).bit_count() <= 2}


def test_shards_miss_no_pair():
    rnd = random.Random(6)
    for n, share in ((100, [0.5] * 64), (10_000_000, [0.5] * 40 + [0.01] * 24), (1_000, [0.0] * 60 + [0.5] * 4)):
        masks = simhash.layout(n, share, 4)
        for _ in range(300):
            x, bits = rnd.getrandbits(64), rnd.sample(range(64), 4)
            y = x ^ sum(1 << b for b in bits)
            assert any(x & m == y & m for m in masks)


def test_simhash_of_odd_tables(spark):
    """Null and repeated ids, repeated rows, extra columns, and no row at all."""
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 1), (3, "a b c d e", 2), (3, "q r s t", 3), (5, None, 4), (6, "", 5), (2, "x " * 200_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [tuple(r) for r in simhash.groups(df).collect()]
    fp = lambda t: f"{fingerprint(t):016x}"
    want = [(None, fp("a b c d e"), 3), (None, fp("a b c d e"), 3), (3, fp("a b c d e"), 3), (3, fp("q r s t"), 3), (5, "0" * 16, 5), (6, "0" * 16, 5), (2, fp("x x x x"), 2)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.groups(df.limit(0)).count() == 0


def test_deduplicate_keeps_one(spark, docs):
    assert simhash.deduplicate(docs).columns == docs.columns
    odd = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "z y x w v u"), (4, "z y x w v u"), (4, "q r s t u v")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[0]) for r in simhash.deduplicate(odd).collect()) == [(0, "a"), (4, "q"), (4, "z")]


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies():
    """Texts with scattered edits, cut and foreign tails, cut heads and inserted blocks, on both sides of 0.8; families share a text and a passage."""
    rnd = random.Random(12)
    prose = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    passage, texts = prose(30), [None, "", " ", "one two", "One  two", "a b c d e"]
    for _ in range(25):
        base = prose(rnd.randrange(60, 400)) + passage
        texts.append(" ".join(base))
        for _ in range(8):
            w, share, kind = list(base), rnd.uniform(0.02, 0.25), rnd.randrange(5)
            k = int(len(w) * share)
            if kind == 0:
                for i in rnd.sample(range(len(w)), max(1, k // 5)):
                    w[i] = f"x{rnd.randrange(9999)}"
            else:
                w = [w[: len(w) - k], w + prose(k), w[k:], w[:50] + prose(k) + w[50:]][kind - 1]
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("many,common,block", [(64, 8, 4096), (2, 2, 4096), (2, 2, 3)])
def test_near_groups_against_all_pairs(spark, monkeypatch, many, common, block):
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "COMMON", common)
    texts = near_copies()
    sets = [five_words(t) for t in texts]
    root = components(list(range(len(texts))), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    assert {tuple(r) for r in simhash.near_groups(df, "id").collect()} == set(root.items())


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 50, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 5], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)]))
        d = np.bitwise_count(np.frombuffer(simhash.sketch(a), np.uint64) ^ np.frombuffer(simhash.sketch(b), np.uint64)).sum()
        assert d <= len(np.setxor1d(a, b)) and simhash.sketch(a) == simhash.sketch(a.copy())


def test_long_lists_against_all_pairs():
    """A list's forest connects what its pairs connect, and is as short as it can be; 6,000 sets that are all near take a moment, and so do as many that aren't."""
    rng = np.random.default_rng(7)

    def make(sets, roots):
        n = np.array([len(s) for s in sets])
        bits = np.array([simhash.sketch(s) for s in sets], object)
        return simhash._LongList(np.arange(len(sets)), n, np.zeros(len(sets), np.int32), np.array(roots), bits, np.zeros(len(sets), np.int32), False)

    base = [np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate([base[i % 4][rng.integers(0, 12) :], rng.integers(0, 1 << 63, 2).astype(np.uint64)])) for i in range(60)]
    roots = [i % 7 if i % 5 else i for i in range(60)]
    found = make(sets, roots)
    pairs = {(min(i, j), max(i, j)) for a, b in found.all() for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if roots[i] != roots[j] and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert want <= pairs
    forest = {(min(i, j), max(i, j)) for a, b in found.forest() for i, j in zip(a.tolist(), b.tolist())}
    same = lambda i, j: roots[i] == roots[j]
    assert forest <= pairs and components(range(60), lambda i, j: same(i, j) or (i, j) in forest) == components(range(60), lambda i, j: same(i, j) or (i, j) in pairs) and len(forest) < len(set(roots))
    for near in (True, False):
        many = [np.unique(np.concatenate([base[0][: 95 if near else 60], rng.integers(0, 1 << 63, 5 if near else 40).astype(np.uint64)])) for _ in range(3000)]
        assert sum(len(a) for a, _ in make(many, list(range(3000))).forest()) == (2999 if near else 0)


def test_deduplicate_keeps_what_is_below(spark):
    """Edited relatives of a similarity of 0.65 to 0.79 all stay."""
    rnd, texts = random.Random(13), []
    while len(texts) < 80:
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(100, 300))]
        edited = list(base)
        for i in rnd.sample(range(len(base)), len(base) // 25):
            edited[i] = f"x{rnd.randrange(9999)}"
        if 0.65 <= jaccard(five_words(" ".join(base)), five_words(" ".join(edited))) <= 0.79:
            texts += [" ".join(base), " ".join(edited)]
    assert simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)


@pytest.mark.parametrize("split,kind", [(4096, "double"), (8, "double"), (8, "float")])
def test_embeddings(spark, monkeypatch, split, kind):
    monkeypatch.setattr(cross_polytope, "SPLIT", split)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    vec = np.concatenate([base, base[:10] + rng.normal(size=(10, 16)) * 0.05, base[:10], np.tile(base[3], (20, 1)) + rng.normal(size=(20, 16)) * 0.02])
    if kind == "float":
        vec = vec.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vec)]
    rows += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [None] * 16, "x"), (904, [], "x"), (905, [1.0, 2.0], "x"), (906, [1e200 if kind == "double" else 1e30] * 16, "x"), (907, [1e-200 if kind == "double" else 1e-30] * 16, "x")]
    got = {r.vec_id: r for r in cross_polytope.groups(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rid string")).collect()}
    fine = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    link = lambda i, j: i in fine and j in fine and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= 0.95
    ids = [r[0] for r in rows]
    root = components(ids, link)
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(link(i, j) for j in ids if j != i), root[i], root[i] == i)


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    own = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight, target, left, rest = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, {}, list(order), float(sum(own.values()))
    while over := [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * own[s]]:
        for s in over:
            target[s] = 3.0 * own[s]
            left.remove(s)
        rest = sum(own.values()) - sum(target.values())
    target |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
    taken = dict.fromkeys(own, 0)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], own[s]) and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows)
    for s in own:
        assert abs(taken[s] - target[s]) <= max(3, 0.03 * target[s])
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_stops_at_the_cap(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 40 + ["b"] * 2 + ["c"] * 3)] + [(100, None, "d"), (100, "v " * 5, "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.target for r in got if r.source_size == 20} == {60.0} and {r.target for r in got if r.source_size == 30} == {90.0}
    assert all(r.taken == 30 for r in got if r.source_size in (20, 30)) and len(got) == len(rows)
    assert sum(r.taken for r in got if r.source_size == 405) == pytest.approx(455 - 60 - 90, abs=10)


def test_matroska_round_trip():
    rnd = random.Random(6)
    for n in (192, 1536, 1536 * 3 + 192, 1536 * 8 * 64 + 384, 1536 * 8 * 130):
        data = bytes(rnd.getrandbits(8) for _ in range(1000)) * (n // 1000 + 1)
        stored = matroska.mux(data[:n])
        media = matroska.demux(stored)
        assert matroska.payload(stored, media) == data[:n]
        at = 0
        for p in media.packets:
            assert p.timestamp_ns == at * 1_000_000_000 // 48_000
            at += p.length
        assert [c[matroska.CUE_CLUSTER] for c in media.cues] == media.clusters
        assert len(matroska.demux(stored[: len(stored) // 2]).packets) <= len(media.packets)
    for frames in ([b"a"], [b"aa", b"bb"], [b"a" * 300, b"b" * 7, b"c" * 900, b""], [b"x" * 5, b"y" * 500, b"z"]):
        kind, body = matroska._lace(frames)
        assert [body[o : o + s] for o, s in matroska._frames(body, 0, len(body), kind)] == frames
    xiph = bytes([2, 255, 1, 3]) + b"a" * 256 + b"bbb" + b"cc"
    assert matroska._frames(xiph, 0, len(xiph), matroska.XIPH) == [(4, 256), (260, 3), (263, 2)]
    with pytest.raises(ValueError):
        matroska.demux(b"RIFFxxxx")


def test_matroska_query(docs, rows):
    got = {r.doc_id: r for r in matroska.text_media(docs).collect()}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def languages(n, seed=0):
    rnd = random.Random(seed)
    kinds = {"aa": "the of and to in is was by".split(), "bb": "les des une dans avec être où ça".split(), "cc": "das ein und nicht für über ist der".split()}
    return [(i, " ".join(rnd.choices(kinds[k], k=rnd.randrange(4, 60))), k) for i in range(n) for k in [rnd.choice(list(kinds))]]


def test_language(spark):
    rows = languages(300) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !", "bb"), (1003, "the of and " * 30_000, None)]
    got = {r.doc_id: r for r in ppm_language.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    none = ppm_language.detect(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und" and none[0].score == 0


def test_code_lengths_are_those_of_a_distribution():
    model = ppm_language.fit({"x": [b"abracadabra abracadabra"], "y": [b"hocus pocus"]})
    p = 2.0 ** -model.cost.reshape(2, -1, model.size).astype(float)
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    long = b"abra hocus" * 100_000
    assert np.allclose(model.bits([long])[0], model.bits([long[:300_000]])[0] * 1.0 + model._some([long[300_000:]], long[299_997:300_000])[0], rtol=1e-6)


def direct_bits(samples, lang, text):
    """Code length by the definition: counts of each context, escapes with exclusion, one byte at a time."""
    seen = sorted({b for ts in samples.values() for t in ts for b in t})
    symbols = {b: i + 2 for i, b in enumerate(seen)}
    size = len(seen) + 2
    counts = {}
    for t in samples[lang]:
        s = [0] * ppm_language.ORDER + [symbols[b] for b in t]
        for i in range(ppm_language.ORDER, len(s)):
            for k in range(ppm_language.ORDER + 1):
                own = counts.setdefault(tuple(s[i - k : i]), {})
                own[s[i]] = own.get(s[i], 0) + 1
    base = [1 / 256] * size
    base[1] = (257 - size + 1) / 256 / 256
    base = [b / sum(base) for b in base]

    def probability(ctx, x):
        own = counts.get(ctx)
        low = (lambda y: probability(ctx[1:], y)) if ctx else (lambda y: base[y])
        if not own:
            return low(x)
        n, q = sum(own.values()), len(own)
        left = 1 - sum(low(y) for y in own)
        escape = q / (n + q) if left > 1e-12 else 0
        return own[x] / (n + (q if escape else 0)) if x in own else escape * low(x) / max(left, 1e-12)

    s = [0] * ppm_language.ORDER + [symbols.get(b, 1) for b in text]
    return sum(-np.log2(max(probability(tuple(s[i - ppm_language.ORDER : i]), s[i]), 1e-9)) for i in range(ppm_language.ORDER, len(s)))


def test_language_against_code_lengths_by_definition(spark, monkeypatch):
    """The query's languages and scores from code lengths that are computed one byte at a time, in one group of languages and in several."""
    rows = languages(36, 3) + [(500, "les THE ein où", None), (501, "les THE ein où", "aa"), (502, None, None), (503, "1 2", "bb"), (501, "les THE ein où", "aa")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    samples = ppm_language.sample(df, ~ppm_language.held_out())
    want = {}
    for _, text, _ in rows:
        if text and any(c.isalpha() for c in text):
            folded = text.lower().encode()
            bits = {g: direct_bits(samples, g, folded) for g in samples}
            best = min(sorted(bits), key=bits.get)
            z = [-b * np.log(2) * min(1, 64 / len(folded)) for b in bits.values()]
            want[text] = (best, 1 / sum(np.exp(v + bits[best] * np.log(2) * min(1, 64 / len(folded))) for v in z))
    for group in (6, 1):
        monkeypatch.setattr(ppm_language, "GROUP", group)
        got = ppm_language.detect(df).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(t for d, t, _ in rows if d == r.doc_id)
            # Groups may see different bytes, which moves what is left for bytes that no sample has.
            lang, score = want.get(text, ("und", 0.0))
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6 if group > 1 else 0.05)
    assert ppm_language.detect(df.limit(0)).count() == 0


def test_a_hundred_languages(spark, monkeypatch):
    """No language is left out, a text too long to draw whole is learned from, and reruns agree."""
    rnd = random.Random(2)
    words = {f"l{k:03d}": ["".join(rnd.choices("abcdefghijklmnop", k=5)) for _ in range(6)] for k in range(100)}
    rows = [(i, " ".join(rnd.choices(words[g], k=12)), g) for i, g in enumerate(list(words) * 6)]
    rows = [r for r in rows if r[2] != "l099"] + [(7000 + i, " ".join(rnd.choices(words["l099"], k=300)), "l099") for i in range(4)]
    monkeypatch.setattr(ppm_language, "TRAIN_BYTES", 900)
    monkeypatch.setattr(ppm_language, "GROUP", 25)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in ppm_language.detect(df).collect()}
    assert {r.lang_pred for r in got.values()} == set(words) and sum(got[i].lang_pred == g for i, _, g in rows) >= 0.99 * len(rows)
    assert {i: tuple(r) for i, r in got.items()} == {r.doc_id: tuple(r) for r in ppm_language.detect(df.repartition(5)).collect()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    rnd = random.Random(8)
    terms = sorted({"".join(rnd.choices("abc", k=rnd.randrange(3, 11))) for _ in range(25)})
    auto = toxicity.Automaton(terms)
    for _ in range(3000):
        w = "".join(rnd.choices("abcd", k=rnd.randrange(1, 13)))
        near = [edits(w, t) for t in terms if edits(w, t) <= auto.edits(t)]
        hit = auto.match(w)
        assert (hit is None) == (not near) and (hit is None or (hit[1] == min(near) and edits(w, terms[hit[0]]) == hit[1]))


def test_toxicity(spark):
    rnd = random.Random(9)
    plain = "the house is near a quiet river and we walk there on most days".split()
    docs, labels = [], []
    for i in range(400):
        w = rnd.choices(plain, k=25)
        toxic = i % 4 == 0
        if toxic:
            w[rnd.randrange(25)] = rnd.choice(["zorblax", "grumphit", "wexlorp"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    docs += [(1000, "you are a zorblaxx indeed", "x"), (1001, None, "x"), (1002, "", "x"), (1003, "a grumphiit walks", "x"), (1004, "the house", "x")]
    labels += [(5000, 1), (None, 1), (1004, None)]
    got = {r.doc_id: r for r in toxicity.detect(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs)
    for i, y in labels[:400]:
        assert got[i].predicted == y
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004)] == [1, 0, 0, 1, 0]
    m = toxicity.Matcher(["zorblax"])
    assert m.hits('he said "zorblax" here')[0][2] == -1 and m.hits("you zorblax")[0][2] == 1 and m.hits("a zorblax")[0][2] == 0


def test_toxicity_query_against_edit_distance(spark):
    """The query's scores from hits that are found by comparing every word with every term."""
    rnd = random.Random(10)
    plain = "the house is near a quiet river and we walk there on most days he said you".split()
    docs, labels = [], []
    for i in range(200):
        w = rnd.choices(plain, k=20)
        if i % 4 == 0:
            w[rnd.randrange(20)] = rnd.choice(["zorblax", "grumphit", "wexlorpian", "zorblex", "wexlorpain", '"zorblax"'])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000, None, "x"), (1001, "", "x"), (3, "another text of 3 zorblax", "x"), (None, "you zorblax", "x")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab, ~toxicity.held_out())

    def nearest(word):
        near = [(edits(word, t), i) for i, t in enumerate(model.terms) if edits(word, t) <= toxicity.Automaton.edits(t)] if len(word) < 64 else []
        return min(near, default=None)

    def hits(text):
        low, out = (text or "").lower(), []
        tokens = [(m[0], m.start(), m.end()) for m in toxicity.TOKEN.finditer(low)]
        for i, (w, a, b) in enumerate(tokens):
            if found := nearest(w):
                near = tokens[max(0, i - 4) : i + 5]
                quoted = any(c in low[near[0][1] : a] for c in toxicity.QUOTES) and any(c in low[b : near[-1][2] + 1] for c in toxicity.QUOTES) or any(t[0] in toxicity.REPORTING for t in tokens[max(0, i - 4) : i])
                out.append((found[1], found[0], -1 if quoted else int(any(t[0] in toxicity.ADDRESS for t in near))))
        return out

    got = toxicity.detect(df, lab).collect()
    assert len(got) == len(docs) and sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(d), round(float(model.score(hits(t))), 9)) for d, t, _ in docs)
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in got)
    assert toxicity.detect(df.limit(0), lab).count() == 0 and {r.score for r in toxicity.detect(df, lab.limit(0)).collect()} == {0.0}


def test_mixing_deals_repeated_rows(spark):
    """Rows without an id, or with one id and size, are dealt to many bins, and reach the target like others."""
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e f g").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    sized = df.select("doc_id", "source", F.lit(7).cast("long").alias("size"))
    assert mixing._numbered(sized).groupBy("source").agg(F.count_distinct("k").alias("n"), F.count("*").alias("c")).where("n <> c").count() == 0
    got = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 20_000 and all(abs(r.taken - r.target) <= 0.01 * r.target for r in got)
    twice = spark.createDataFrame([(5, "a b", "s", "e")] * 40 + [(None, "c d e", None, "f")] * 40, "doc_id long, text string, source string, copies string")
    assert mixing.mix(twice).count() == 80


def test_mixing_tilts_exponentially(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(1, 200), rnd.choice("abc")) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        own = [r for r in got if rows[r.doc_id][2] == s]
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, abs=0.05)
        slope = {round(np.log(r.rate) / r.size, 9) for r in own if r.rate < 3}
        assert max(slope) - min(slope) < 1e-8


def test_damaged_media_have_the_packets_before_the_fault(spark):
    rnd = random.Random(8)
    good = matroska.mux(bytes(rnd.getrandbits(8) for _ in range(192 * 200)))
    whole, bad = matroska.demux(good).packets, []
    for _ in range(3000):
        b = bytearray(good)
        for _ in range(rnd.randrange(1, 5)):
            b[rnd.randrange(4, len(b) if rnd.random() < 0.5 else 400)] = rnd.randrange(256)
        b = bytes(b[: rnd.randrange(4, len(b))] if rnd.random() < 0.2 else b)
        bad.append(b)
        for p in matroska.demux(b).packets:
            assert 0 <= p.offset and p.length >= 0 and p.offset + p.length <= len(b) and 0 <= p.timestamp_ns < 1 << 63
    rows = [(0, good), (1, None), (2, b"RIFF"), (3, b"")] + [(10 + i, b) for i, b in enumerate(bad[:60])]
    got = matroska.packet_table(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert [(r.track, r.timestamp_ns, r.byte_offset, r.byte_length, r.keyframe, r.lacing, r.cluster) for r in sorted((r for r in got if r.media_id == 0), key=lambda r: r.packet)] == [tuple(p) for p in whole]
    assert not {1, 2, 3} & {r.media_id for r in got}
    texts = spark.createDataFrame([(1, "ä" * 5000), (2, None)], "doc_id long, text string")
    packets = matroska.packet_table(matroska.files(texts)).collect()
    assert sum(r.byte_length for r in packets if r.media_id == 1) == 10_176 and sum(r.byte_length for r in packets if r.media_id == 2) == 192


def test_embeddings_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [2.0, 4.0]), (5, [0.0, -0.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in cross_polytope.groups(df).collect()), key=str)
    assert got == [(0, 3, 1, None), (1, 3, 1, True), (1, 3, 1, True), (4, 3, 1, False), (5, 0, 5, True)]
    assert cross_polytope.groups(df.limit(0)).count() == 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    text = lambda i, t: None if t is None else t + (f" u{i}" * 3 if len(t) > 20 and i % 12 == 8 else "")
    data = [(d, text(d, t), lang, s, n) for d, t, lang, s, n, *_ in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    letters = [r for r in data if r[1] and any(c.isalpha() for c in r[1])]
    assert kept[0] == len(letters) and kept[1] <= len({r[1] for r in letters}) and kept[3] == kept[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4]


def test_pipeline_stages_by_brute_force(spark, rows, tmp_path):
    """Each stage's rows against its definition, on what the stage before kept."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    base = [f"w{i}" for i in range(120)]
    near = [" ".join([*base[:k], "odd", *base[k + 1 :]]) for k in (3, 60, 117)] + [" ".join(base)]
    data = [(d, t, lang, s, n) for d, t, lang, s, n, *_ in rows] + [(1000 + i, t, "en", "a", len(t)) for i, t in enumerate(near)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(docs.collect(), key=lambda r: r.doc_id) if k < 4 else docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((before, docs.collect()))
    (a, b), (c, d), (e, f), (g, h), (i, j) = seen
    assert {r.doc_id for r in b} == {r.doc_id for r in a if r.text and any(x.isalpha() for x in r.text)} and {r.doc_id: r.text for r in b}.items() <= {r.doc_id: r.text for r in a}.items()
    sets = {r.doc_id: five_words(r.text) for r in c}
    root = components(sorted(sets), lambda x, y: jaccard(sets[x], sets[y]) >= 0.8)
    assert {r.doc_id for r in d} == set(root.values()) and len(d) < len(c)
    want = {}
    for doc, words, mask in cut([(r.doc_id, r.text) for r in e], WORD.findall, 20):
        kept = " ".join(w for w, m in zip(words, mask) if not m)
        if kept or not any(mask):
            want[doc] = kept if any(mask) else next(r.text for r in e if r.doc_id == doc)
    assert {r.doc_id: r.text for r in f} == want and all(r.n_chars == len(r.text) for r in f if r.text != next(x.text for x in e if x.doc_id == r.doc_id))
    times, size = {}, {r.doc_id: len(WORD.findall(r.text)) for r in g}
    for r in h:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3 and times.keys() <= size.keys()
    goals = {r.doc_id: (r.target, r.taken) for r in mixing.mix(spark.createDataFrame(g)).collect()}
    for s in {r.source for r in g}:
        own = [r.doc_id for r in g if r.source == s]
        assert abs(sum(times.get(x, 0) * size[x] for x in own) - goals[own[0]][0]) <= max(3, 0.05 * goals[own[0]][0])
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in j) == sorted((r.doc_id, lib.encode_ordinary(r.text)) for r in i)


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, "a text without an id", None, None, None, 1), (1, None, "en", "s", 0, 2), (1, "twice the id", "en", None, 3, 3), (1, "twice the id", "en", None, 3, 3), (2, "the end of all", None, "s", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int")
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, data, str(tmp_path)).collect()

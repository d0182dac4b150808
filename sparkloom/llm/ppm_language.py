"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes is grown from a bounded sample, then
frozen. A byte's probability in a context is its count over n + q (n bytes seen there, q of them
distinct); what is not seen there costs an escape of q / (n + q) and is looked up in the next shorter
context, where the bytes already excluded take no share, down to equal shares of all bytes. So each
context's probabilities sum to 1 and a text's code length in a language is exact. Frozen trees of all
languages are merged into one automaton: the longest context known to any of them selects a row, the
next byte a cell, and the cell holds the cost in every language, computed once. Scoring is two gathers a byte
over whole batches.

Fitting reads at most ``TRAIN_BYTES`` of text for each language, and ``TRAIN_TOTAL`` for all (the documented sample, drawn by a hash of
id and text; a drawn text beyond that is read to there). A language keeps its ``MAX_CONTEXTS`` commonest long contexts, whatever other
languages there are. Languages are scored in groups of ``GROUP``, each with an automaton of its own, which bounds what is broadcast; a text's
best language and score are carried from group to group. Scoring is per row, without a shuffle.

Defined results: null, empty and letterless texts are ``und`` with score 0; very long texts are scored
whole; ties go to the language first by code point; repeated rows get equal results; without any
training row every text is ``und``; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, bound_batches, crc_mod

ORDER = 3
TRAIN_BYTES = 600_000
TRAIN_DOCS = 1_500
TRAIN_TOTAL = 64_000_000
#: Contexts of ``ORDER`` bytes that a language keeps, the commonest ones.
MAX_CONTEXTS = 6_000
#: Languages whose shares are broadcast; beyond that documents meet them by a shuffle.
MANY_LANGUAGES = 100_000
#: Languages in one automaton.
GROUP = 6
LETTER = regex.compile(r"\p{L}")
BREAK = 0  # the symbol before a text's first byte


def _fold(text: str) -> bytes:
    """Lower case, so that capitals need no contexts of their own."""
    return text.lower().encode("utf-8", "replace")


class Model:
    """Frozen trees: symbols of bytes, states of context triples and costs in bits."""

    def __init__(self, langs: list[str], symbol: np.ndarray, size: int, state: np.ndarray, cost: np.ndarray):
        self.langs, self.symbol, self.size, self.state, self.cost = langs, symbol, size, state, cost

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            end, room = at, 0
            while end < len(texts) and (end == at or room + len(texts[end]) < 1 << 19):
                room += len(texts[end]) + ORDER
                end += 1
            if end == at + 1 and len(texts[at]) > 1 << 19:
                t = texts[at]
                for a in range(0, len(t), 1 << 19):  # each piece sees the bytes before it
                    head = t[max(0, a - ORDER) : a]
                    out[at] += self._some([t[a : a + (1 << 19)]], head)[0]
            else:
                out[at:end] = self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[bytes], head: bytes = b"") -> np.ndarray:
        lead = b"\0" * (ORDER - len(head)) + head
        raw = np.frombuffer(lead + lead.join(texts), np.uint8)
        s, a = self.symbol[raw].astype(np.int32), self.size
        lens = np.array([len(t) for t in texts])
        row = self.state[(s[:-3] * a + s[1:-2]) * a + s[2:-1]] if len(s) > 3 else np.zeros(0, np.int32)
        cells = row * np.int32(a) + s[3:]
        starts = np.concatenate([[0], np.cumsum(lens[:-1] + ORDER)])
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            sums = np.concatenate([[0.0], np.cumsum(self.cost[k][cells], dtype=np.float64)])
            out[:, k] = sums[starts + lens] - sums[starts]
        return out


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Grow, freeze and merge the trees of ``samples``: language to folded texts."""
    langs = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[np.unique(np.frombuffer(t, np.uint8))] = True
    # Symbol 0 stands for a text's start, 1 for bytes that no sample has, the rest for bytes seen.
    symbol = np.ones(256, np.uint8 if seen.sum() < 250 else np.uint16)
    symbol[seen] = np.arange(2, 2 + seen.sum())
    symbol[0] = BREAK
    size = int(seen.sum()) + 2
    grams: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang in langs:
        buf = np.frombuffer(b"".join(b"\0" * ORDER + t for t in samples[lang]), np.uint8)
        s = symbol[buf].astype(np.int64)
        per = []
        for order in range(ORDER + 1):
            code = s[ORDER:]
            for k in range(1, order + 1):
                code = code + s[ORDER - k : len(s) - k] * size**k
            per.append(np.unique(code[s[ORDER:] != BREAK], return_counts=True))
        grams[lang] = per
    # A language's rarest contexts of full length give way, so its code lengths don't depend on other languages.
    for lang in langs:
        code, count = grams[lang][ORDER]
        ctx, inverse = np.unique(code // size, return_inverse=True)
        if len(ctx) > MAX_CONTEXTS:
            kept = np.zeros(len(ctx), bool)
            kept[np.argsort(-np.bincount(inverse, count), kind="stable")[:MAX_CONTEXTS]] = True
            grams[lang][ORDER] = code[kept[inverse]], count[kept[inverse]]
    # States: contexts known to any language, by order.
    known = [np.zeros(1, np.int64)]
    for order in range(1, ORDER + 1):
        known.append(np.unique(np.concatenate([grams[g][order][0] // size for g in langs])))
    base = np.concatenate([[0], np.cumsum([len(k) for k in known])])
    cost = np.empty((len(langs), base[-1] * size), np.float32)
    for i, lang in enumerate(langs):
        prob = np.empty((base[-1], size))
        for order in range(ORDER + 1):
            ctx = known[order]
            code, count = grams[lang][order]
            own = np.zeros((len(ctx), size))
            at = np.searchsorted(ctx, code // size)
            ok = (at < len(ctx)) & (ctx[np.minimum(at, len(ctx) - 1)] == code // size)
            own[at[ok], (code % size)[ok]] = count[ok]
            if order:
                short = ctx % size ** (order - 1)
                low = prob[base[order - 1] + np.searchsorted(known[order - 1], short)]
            else:
                low = np.full((1, size), 1.0 / 256)
                low[:, 1] = (257 - size + 1) / 256.0 / 256  # any one of the bytes that no sample has
                low[:, BREAK] = 1.0 / 256
                low /= low.sum(1, keepdims=True)
            n, q = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
            left = 1 - np.where(own > 0, low, 0).sum(1, keepdims=True)
            escape = np.where(left > 1e-12, q / np.maximum(n + q, 1), 0)
            kept = np.where(own > 0, own / np.maximum(n + np.where(escape > 0, q, 0), 1), escape * low / np.maximum(left, 1e-12))
            prob[base[order] : base[order + 1]] = np.where(n > 0, kept, low)
        cost[i] = -np.log2(np.maximum(prob, 1e-9)).ravel()
    # The state of each triple of symbols: its longest known suffix.
    triple = np.arange(size**3)
    state = np.zeros(size**3, np.int32)
    for order in range(1, ORDER + 1):
        suffix = triple % size**order
        at = np.minimum(np.searchsorted(known[order], suffix), len(known[order]) - 1) if len(known[order]) else None
        if at is not None:
            hit = known[order][at] == suffix
            state[hit] = base[order] + at[hit]
    return Model(langs, symbol, size, state, cost)


def sample(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[bytes]]:
    """About TRAIN_DOCS documents or TRAIN_BYTES of folded text for each language, by a hash of id and text, and at least one document."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")
    )
    # The share to draw follows from counts, so that no task gathers a language and the driver gets a bounded part.
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("size"), F.min(F.struct(F.pmod("h", F.lit(1_000_003)).alias("u"), "h")).alias("first"))
    langs = counts.count()
    if not langs:
        return {}
    room = min(TRAIN_BYTES, TRAIN_TOTAL // langs)
    share = F.least(F.lit(1.0), F.lit(TRAIN_DOCS) / F.col("n"), F.lit(room) / (F.col("n") * F.col("size")))
    shares = counts.select("lang", share.alias("share"), "first")
    shares = F.broadcast(shares) if langs <= MANY_LANGUAGES else shares  # a short row for each, counted above
    picked = rows.join(shares, "lang").where((F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0) < F.col("share")) | (F.col("h") == F.col("first.h")))
    # Rows that are equal in id and text are drawn together and count once.
    drawn = picked.groupBy("lang", "h").agg(F.min(F.substring("text", 1, room)).alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    used: dict[str, int] = {}
    for r in sorted(drawn, key=lambda r: (r.lang, r.h % 1_000_003, r.h)):
        t = _fold(r.text)[:room]
        if used.get(r.lang, 0) < 2 * room:
            out.setdefault(r.lang, []).append(t)
            used[r.lang] = used.get(r.lang, 0) + len(t)
    return out


def fit_all(samples: dict[str, list[bytes]]) -> list[Model]:
    """Models of all languages, ``GROUP`` in each."""
    langs = sorted(samples)
    return [fit({g: samples[g] for g in langs[at : at + GROUP]}) for at in range(0, len(langs), GROUP)]


def _predict(model: Model, texts: list[str | None], before: list[tuple]) -> list[tuple]:
    """(language, its bits, bytes, log of the sum of all languages' likelihoods) of each text, over this model's languages and those ``before``; nulls where there is none yet, or the text has no letter."""
    live = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    out = list(before)
    if live:
        folded = [_fold(texts[i]) for i in live]
        bits = model.bits(folded)
        # Evidence of a long text is scaled to that of 64 bytes, so the score still tells mixed texts from pure ones.
        size = np.array([max(1.0, len(t)) for t in folded])
        scale = np.log(2) * np.minimum(1, 64 / size)
        z = -bits * scale[:, None]
        total = z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
        best = bits.argmin(1)
        for k, i in enumerate(live):
            lang, had, _, sum_ = before[i]
            mine = float(bits[k, best[k]])
            # Groups are in the order of code points, so that an earlier one wins a tie.
            out[i] = (lang if lang is not None and had <= mine else model.langs[best[k]], mine if had is None else min(had, mine), float(size[k]), float(total[k] if sum_ is None else np.logaddexp(total[k], sum_)))
    return out


def identify(docs: DataFrame, models: list[Model], text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """All columns of ``docs`` with the language, score (0 to 1) and bits a byte added under the names ``out``."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = [f for f in docs.schema.fields if f.name not in out]
    state = ("__ppm_lang", "__ppm_bits", "__ppm_bytes", "__ppm_sum")
    frame = docs.select(*[F.col(f"`{f.name}`") for f in names], F.col(text_col).alias("__ppm_text"), F.lit(None).cast("string").alias(state[0]), *[F.lit(None).cast("double").alias(c) for c in state[1:]])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names), f"__ppm_text string, {state[0]} string, {state[1]} double, {state[2]} double, {state[3]} double"])
    arrow, scratch = arrow_schema(schema), Scratch(spark)

    def step(model: Model):
        shared = spark.sparkContext.broadcast(model)  # bounded by GROUP and MAX_CONTEXTS

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    text, *before = (c.to_pylist() for c in part.columns[-5:])
                    found = list(zip(*_predict(shared.value, text, list(zip(*before)))))
                    arrays = [c.cast(f.type) for c, f in zip(part.columns[:-4], arrow)]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(list(c), arrow.field(n).type) for c, n in zip(found, state)], schema=arrow)

        return run

    for k, model in enumerate(models):
        frame = frame.mapInArrow(step(model), schema)
        if k + 1 < len(models):
            frame = scratch.keep(frame, f"scored{k}")  # one model at a time in a worker
            scratch.drop(f"scored{k - 1}")
    lang, bits, size, total = map(F.col, state)
    score = F.when(lang.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(-bits * F.lit(float(np.log(2))) * F.least(F.lit(1.0), F.lit(64.0) / size) - total)))
    return frame.select(*[F.col(f"`{f.name}`") for f in names], F.coalesce(lang, F.lit("und")).alias(out[0]), score.alias(out[1]), F.coalesce(bits / size, F.lit(0.0)).alias(out[2]))


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(F.col(id_col), 3) == 1


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte: fitted on the documents that are not held out."""
    return identify(docs.select("doc_id", "text"), fit_all(sample(docs, ~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that have no language, ``lang`` set to the one found."""
    named = identify(docs, fit_all(sample(docs, ~held_out())), out=("__lang", "__score", "__bits"))
    return named.where(F.col("__lang") != "und").withColumn("lang", F.col("__lang")).select(*docs.columns)

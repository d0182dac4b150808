"""Toxicity: a learned lexicon matched through Levenshtein automata, weighed by context.

The lexicon holds the words that mark toxic training texts. It is kept as a trie; the automaton of
"within k edits of some term" is the trie intersected with Levenshtein automata: its states are sets of
(trie node, edits), determinised when first met and remembered, so a word costs one lookup a letter and most words die
after a few. A hit counts with the weight its term has at that number of edits in the training rows,
less inside quotation marks or after words of reporting, more near words of address. A logistic
regression over a text's hits gives the score.

Fitting uses at most ``TRAIN_DOCS`` labelled rows (the documented sample, drawn by a hash of doc_id);
counts are aggregated by Spark, and only the lexicon and the hits of that sample reach the driver. Scoring is per
row, without a shuffle; the model it broadcasts is bounded by ``TERMS``.

Defined results: null and empty texts get the score of a text without hits; very long texts are read
whole; repeated rows get equal scores; null labels are ignored and a document labelled twice takes the higher label; of texts that share a doc_id the first in
order is learned from; terms of equal weight go in order, and a word as near to two terms takes the first; without toxic training
rows every score is 0; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, text_map

TRAIN_DOCS = 16_000
TERMS = 600
MIN_DOCS = 4
WINDOW = 4
TOKEN = re.compile(r"[^\W_]+")
# Marks of quotation, words of reporting and of address.
QUOTES = "\"“”„«»‟"
REPORTING = frozenset("said says called calls quote quoted word term slur wrote dit dite appelle mot sagte sagt nannte wort dijo dice llama palabra".split())
ADDRESS = frozenset("you your youre u du dich dein ihr euch tu toi te vous votre tú usted ustedes vos eres".split())
WORDS_KEPT = 400_000


class Automaton:
    """Words within ``edits(term)`` edits of a term: none below five letters, one below nine, two beyond."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.room: list[int] = [0]  # most edits that a term below this node allows
        for i, term in enumerate(terms):
            node, k = 0, self.edits(term)
            self.room[0] = max(self.room[0], k)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.room.append(0)
                node = self.next[node][c]
                self.room[node] = max(self.room[node], k)
            self.ends[node] = i
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.hits: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state of ``nodes`` (fewest edits of each) after closing it under missing letters; -1 if empty."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.next[node].values():
                if e <= self.room[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            ends = [(e, self.ends[n]) for n, e in nodes.items() if self.ends[n] >= 0 and e <= self.edits(self.terms[self.ends[n]])]
            best = min(ends, default=None)
            self.hits.append((best[1], best[0]) if best else None)
        return got

    def _move(self, state: int, c: str) -> int:
        new: dict[int, int] = {}
        for node, e in self.sets[state].items():
            child = self.next[node].get(c)
            if child is not None and e < new.get(child, 9) and e <= self.room[child]:
                new[child] = e
            if e + 1 <= self.room[node]:
                if e + 1 < new.get(node, 9):  # a letter too many
                    new[node] = e + 1
                for d, child in self.next[node].items():  # another letter
                    if d != c and e + 1 <= self.room[child] and e + 1 < new.get(child, 9):
                        new[child] = e + 1
        got = self.moves[state][c] = self._state(new)
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        if len(self.sets) > 100_000:  # states are found again when needed
            self.ids, self.sets, self.moves, self.hits = {}, [], [], []
            self.start = self._state({0: 0})
        state = self.start
        for c in word:
            nxt = self.moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if state < 0:
                return None
        return self.hits[state]


class Matcher:
    """Hits of texts: (term, edits, context), where context is -1 quoted, 0 plain, 1 near an address."""

    def __init__(self, terms: list[str]):
        self.auto = Automaton(terms)
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text or not self.auto.terms:
            return []
        low, known = text.lower(), self.known
        words = set(TOKEN.findall(low))
        if len(known) > WORDS_KEPT:
            known.clear()
        found = {}
        for w in words:
            try:
                hit = known[w]
            except KeyError:
                hit = known[w] = self.auto.match(w) if len(w) < 64 else None
            if hit:
                found[w] = hit
        if not found:
            return []
        out = []
        tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(low)]
        for i, (w, a, b) in enumerate(tokens):
            if w in found:
                near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                before, after = low[near[0][1] : a], low[b : near[-1][2] + 1]
                quoted = (any(q in before for q in QUOTES) and any(q in after for q in QUOTES)) or any(t[0] in REPORTING for t in tokens[max(0, i - WINDOW) : i])
                out.append((*found[w], -1 if quoted else int(any(t[0] in ADDRESS for t in near))))
        return out


def figures(hits: list[tuple[int, int, int]], weight: dict[tuple[int, int], float]) -> list[float]:
    """What the regression sees: the strongest hit, the sum of the strongest hit of each term, direct and quoted, and address."""
    best: dict[int, float] = {}
    quoted, direct, address = 0.0, 0.0, 0.0
    for term, e, context in hits:
        w = weight.get((term, e), 0.0)
        if context < 0:
            quoted = max(quoted, w)
            w *= 0.4
        else:
            direct = max(direct, w)
        address = max(address, w if context > 0 else 0.0)
        best[term] = max(best.get(term, 0.0), w)
    total = sum(best.values())
    return [max(best.values(), default=0.0), min(total, 30.0), direct, quoted, address]


class Model:
    def __init__(self, terms: list[str], weight: dict[tuple[int, int], float], beta: np.ndarray | None):
        self.terms, self.weight, self.beta = terms, weight, beta

    def score(self, hits) -> float:
        if self.beta is None:
            return 0.0
        z = float(self.beta[0] + np.dot(self.beta[1:], figures(hits, self.weight)))
        return 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """Learn lexicon, weights and regression from the labelled rows that ``train`` selects."""
    spark = docs.sparkSession
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    n = own.count()
    share = min(1.0, TRAIN_DOCS / max(n, 1))
    drawn = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    scratch = Scratch(spark)
    # The drawn labels are bounded by TRAIN_DOCS, so they may be broadcast.
    rows = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.first("__toxic").cast("int").alias("y"), F.min("text").alias("text")).select("y", "text"), "train")
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1:
        scratch.drop("train")
        return Model([], {}, None)

    def words():
        return lambda part: [(w, y) for y, t in part if t for w in set(TOKEN.findall(t.lower())) if 3 <= len(w) < 40]

    counts = text_map(rows, words, "word string, y int").groupBy("word").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1.0)) - F.log((F.col("c0") + 0.5) / (n0 + 1.0))
    lexicon = counts.where((F.col("c1") >= MIN_DOCS) & (F.col("c1") > F.col("c0"))).withColumn("w", odds).orderBy(F.desc(F.col("c1") * F.col("w")), "word").limit(TERMS)
    terms = sorted(r.word for r in lexicon.select("word").collect())

    def hits():
        matcher = Matcher(terms)

        def step(part):
            out = []
            for y, t in part:
                # For each term, number of edits and context once.
                found = sorted(set(matcher.hits(t)))
                out.append((y, [v for h in found for v in h]))
            return out

        return step

    seen = [(r.y, list(zip(*[iter(r.hits)] * 3))) for r in text_map(rows, hits, "y int, hits array<int>").collect()]
    scratch.drop("train")
    with_hit = {1: {}, 0: {}}
    for y, found in seen:
        for key in {(t, e) for t, e, _ in found}:
            with_hit[int(y > 0)][key] = with_hit[int(y > 0)].get(key, 0) + 1
    weight = {}
    for t in range(len(terms)):
        for e in range(Automaton.edits(terms[t]) + 1):
            a, b = with_hit[1].get((t, e), 0), with_hit[0].get((t, e), 0)
            # Misspellings that training rows never show count like the term, a little less for each edit.
            if a + b < 3 and e:
                whole = weight[(t, 0)]
                weight[(t, e)] = whole * 0.75**e if not b else 0.0
            else:
                weight[(t, e)] = max(0.0, float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))))
    y = np.array([float(v > 0) for v, _ in seen])
    x = np.array([figures(h, weight) for _, h in seen])
    return Model(terms, weight, _logistic(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_hits, n_quoted, n_misspelled of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weight, model.beta))

    def start():
        m = Model(*shared.value)
        matcher = Matcher(m.terms)

        def step(rows):
            out = []
            for doc, t in rows:
                h = matcher.hits(t)
                s = m.score(h)
                out.append((doc, s, int(s >= 0.5), len(h), sum(c < 0 for _, _, c in h), sum(e > 0 for _, e, _ in h)))
            return out

        return step

    return text_map(docs.select(F.col(id_col), F.col(text_col)), start, "doc_id long, score double, predicted int, n_hits int, n_quoted int, n_misspelled int")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(F.col(id_col), 5) == 0


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and counts of hits: fitted on the labelled rows that are not held out."""
    return score(docs, fit(docs, labels, ~held_out())).withColumn("held_out", held_out())

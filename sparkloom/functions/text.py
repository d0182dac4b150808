"""String tests: wildcards, case folding and full-text terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.tree import QueryError

# Folding of full-text characters, fixed values: letters fold to lower case without accents, but å æ ð ø þ ß stay.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "ÀÁÂÃÄàáâãä" + "Åå" + "Ææ" + "Çç" + "ÈÉÊËèéêë" + "ÌÍÎÏìíîï" + "Ðð" + "Ññ" + "ÒÓÔÕÖòóôõö" + "Øø" + "ÙÚÛÜùúûü" + "Ýý" + "Þþ"
FOLD_TO = "abcdefghijklmnopqrstuvwxyz" + "aaaaaaaaaa" + "åå" + "ææ" + "cc" + "eeeeeeee" + "iiiiiiii" + "ðð" + "nn" + "oooooooooo" + "øø" + "uuuuuuuu" + "yy" + "þþ"
SWALLOWED = "×÷"
TERM = "0-9a-zåæðøþß"
TERM_BYTES = 64


def like(text: Column, pattern: str) -> Column:
    """``*`` is any run and ``?`` one character, without escapes, over the whole text. A pattern's end of several stars wants a character."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern))
    if re.search(r"\*\*$", pattern):
        out = out[:-2] + ".+"
    return text.rlike(f"(?s)^{out}\\z")


def terms(text: Column) -> Column:
    """Full-text terms of a text, folded, each cut at 64 bytes: a letter that no longer fits is left out, a narrower one after it may fit."""
    folded = F.translate(text, FOLD_FROM + SWALLOWED, FOLD_TO)
    words = F.regexp_extract_all(folded, F.lit(f"[{TERM}]+"), F.lit(0))  # several times as fast as a search for all that is no term
    fits = lambda out, c: F.when(F.octet_length(out) + F.octet_length(c) <= TERM_BYTES, F.concat(out, c)).otherwise(out)
    return F.transform(words, lambda w: F.when(F.octet_length(w) > TERM_BYTES, F.aggregate(F.split(w, ""), F.lit(""), fits)).otherwise(w))


def weighted_terms(text: Column) -> Column:
    """(term, positions, frequency, weight) of each term of a text, in order of first occurrence.

    The k-th occurrence of a term adds half of what the one before adds to its frequency, beginning with 1; the weight is the
    frequency times 0.5 plus half of the term's share of all terms.
    """
    t = terms(text)
    n = F.size(t)

    def one(w: Column) -> Column:
        at = F.filter(F.transform(t, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
        frequency = 2 - F.pow(F.lit(2.0), 1 - F.size(at))
        return F.struct(w.alias("term"), at.alias("positions"), frequency.alias("frequency"), (frequency * (0.5 * F.size(at) / n + 0.5)).alias("weight"))

    return F.transform(F.array_distinct(t), one)


def term_weights(text: Column) -> Column:
    """(terms, weight): the number of different terms of a text and the sum of their weights as ``weighted_terms`` has them, null where there is no term.

    One pass over the sorted terms, for texts of any length. From its k-th occurrence a term adds ``half`` = 2^(1-k) to its frequency.
    """
    start = {"last": F.lit(None).cast("string"), "k": F.lit(0), "half": F.lit(1.0), "terms": F.lit(0).cast("long"), "all": F.lit(0).cast("long"), "frequency": F.lit(0.0), "times": F.lit(0.0)}

    def add(a: Column, w: Column) -> Column:
        same = a["last"].eqNullSafe(w)
        k, half = F.when(same, a["k"] + 1).otherwise(F.lit(1)), F.when(same, a["half"] / 2).otherwise(F.lit(1.0))
        # ``times`` sums frequency times occurrences, (2 - half) k, of which (2 - 2 half) (k - 1) is there from the one before.
        new = {"last": w, "k": k, "half": half, "terms": a["terms"] + F.when(same, 0).otherwise(1), "all": a["all"] + 1, "frequency": a["frequency"] + half, "times": a["times"] + 2 + half * (k - 2)}
        return F.struct(*[c.alias(n) for n, c in new.items()])

    def end(a: Column) -> Column:
        return F.when(a["all"] > 0, F.struct(a["terms"].alias("terms"), (0.5 * a["times"] / a["all"] + 0.5 * a["frequency"]).alias("weight")))

    return F.aggregate(F.sort_array(terms(text)), F.struct(*[c.alias(n) for n, c in start.items()]), add, end)


def fold(word: str) -> str:
    out = ""
    for c in word.translate(str.maketrans(FOLD_FROM, FOLD_TO, SWALLOWED)):
        if len((out + c).encode()) <= TERM_BYTES:
            out += c
    return out


def _spellings(letter: str) -> str:
    """A character class of all that folds to ``letter``."""
    return "[" + letter + "".join(a for a, b in zip(FOLD_FROM, FOLD_TO) if b == letter) + "]"


def _begins(word: str):
    return lambda t: t.startswith(word)


def search(text: Column, wanted: str, tokens: Column | None = None) -> Column:
    """All words of ``wanted`` have to occur; ``-word`` must not, ``word*`` is a prefix. A text that is null has no words.

    ``tokens``: the text's terms, where they are stored. Else only a text that holds the longest word asked for, wherever in a term, is taken apart.
    """
    have, prefix, avoid = set(), set(), set()
    for word in wanted.split():
        out, start = word.startswith("-"), word.endswith("*")
        body = fold(word.lstrip("-").rstrip("*"))
        if not body:
            continue
        if not re.fullmatch(f"[{TERM}]+", body):
            raise QueryError(f"Non alphanumeric characters in search word '{word}'")
        if out and start:
            raise QueryError("A word to leave out can't be a prefix")
        (avoid if out else prefix if start else have).add(body)
    if not have and not prefix and not avoid:
        raise QueryError("There is no word to search for")
    if have & avoid:
        raise QueryError("A word is both asked for and left out")
    stored = tokens is not None
    tokens, test = tokens if stored else terms(text), F.lit(True)
    for w in sorted(have):
        test = test & F.array_contains(tokens, w)
    for w in sorted(prefix):
        test = test & F.exists(tokens, _begins(w))
    for w in sorted(avoid):
        test = test & ~F.array_contains(tokens, w)
    # The longest word is looked for in the raw text, in all spellings that fold to it, before a text is taken apart.
    longest = max((w for w in have | prefix if len(w.encode()) < TERM_BYTES - 2), key=lambda w: (len(w), w), default=None)
    if longest and not stored:
        test = F.when(text.rlike(f"[{SWALLOWED}]*".join(map(_spellings, longest))), test).otherwise(F.lit(False))
    return F.coalesce(test, F.lit(not have and not prefix))

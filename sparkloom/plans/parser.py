"""Predicate text to syntax tree: a scanner and a recursive-descent parser."""

from __future__ import annotations

import base64
import datetime as dt
import math
import re
from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from .tree import And, Arith, Between, Binary, Compare, Const, Distinct, Instant, Key, Limit, ListConst, Not, ObjectId, Or, Path, Query, QueryError, Shape, Sort, SubQuery, Truth, Uuid

TOKEN = re.compile(
    r"""\s*(?:
    (?P<date>\d{4}-\d\d?-\d\d?[T@]\d\d?:\d\d?:\d\d?(?::\d+)?)
  | (?P<epoch>T-?\d+:-?\d+\b)
  | (?P<uuid>uuid\([0-9a-fA-F-]{36}\))
  | (?P<oid>oid\([0-9a-fA-F]{24}\))
  | (?P<b64>[bB]64"[A-Za-z0-9+/=]*"|[bB]64'[A-Za-z0-9+/=]*')
  | (?P<link>L\d+:\d+\b|O\d+\b)
  | (?P<hex>[+-]?0[xX][0-9a-fA-F]+)
  | (?P<inf>[+-]?(?:infinity|inf)\b)
  | (?P<nan>[+-]?nan\b)
  | (?P<float>[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?f?|[+-]?\d+[eE][+-]?\d+f?|[+-]?\d+f\b)
  | (?P<int>[+-]?\d+)
  | (?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
  | (?P<arg>\$K?\d+)
  | (?P<op>==|!=|<>|<=|=<|>=|=>|<|>|=|&&|\|\||!|\+|-|\*|/|\(|\)|\{|\}|\[|\]|,|\.)
  | (?P<fold>\[c\])
  | (?P<id>(?:[@$]?(?:[^\W\d]|\\.)(?:\w|\\.|\$)*))
    )""",
    re.X | re.I,
)
ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}
COMPARE = {"==": "==", "=": "==", "!=": "!=", "<>": "!=", "<": "<", ">": ">", "<=": "<=", "=<": "<=", ">=": ">=", "=>": ">="}
WORDS = {"beginswith": "BEGINSWITH", "endswith": "ENDSWITH", "contains": "CONTAINS", "like": "LIKE", "in": "IN", "text": "TEXT", "geowithin": "GEOWITHIN"}
QUANTIFIERS = {"any": "ANY", "some": "ANY", "all": "ALL", "none": "NONE"}
AFTER = {"sort", "distinct", "limit"}


def scan(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token."""
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        # [c] only means case folding directly after an operator; elsewhere brackets hold an index.
        m = re.compile(r"\s*\[c\]", re.I).match(text, at)
        if m and out and (out[-1][0] == "op" and out[-1][1] in COMPARE or out[-1][1].lower() in WORDS):
            out.append(("fold", "[c]"))
            at = m.end()
            continue
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"Invalid predicate: nothing known at '{text[at : at + 20]}'")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind in ("int", "float", "hex", "inf") and value[0] in "+-" and out and (out[-1][0] in ("int", "float", "hex", "id", "arg") or out[-1][1] in (")", "]")) and not (out[-1][0] == "id" and out[-1][1].lower() in WORDS):
            kind, value = "op", value[0]  # a sign between two operands is an operation
            at = m.start(m.lastgroup) + 1
        else:
            at = m.end()
        out.append((kind, value))
    return out


class Parser:
    def __init__(self, text: str, args: Sequence[Any] = ()):
        self.tokens, self.at, self.args = [*scan(text), ("end", "")], 0, args

    # -- tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def word(self) -> str:
        return self.tokens[self.at][1]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def ahead(self, *words: str, k: int = 0) -> bool:
        kind, value = self.tokens[min(self.at + k, len(self.tokens) - 1)]
        return kind in ("op", "id") and value.lower() in words

    def got(self, *words: str) -> bool:
        if self.ahead(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.got(word):
            raise QueryError(f"Invalid predicate: '{word}' is missing before '{self.word}'")

    # -- predicates

    def query(self) -> Query:
        where, order = self.either(), []
        while self.ahead(*AFTER):
            order.append(self.ordering())
        if self.kind != "end":
            raise QueryError(f"Invalid predicate: unexpected '{self.word}'")
        return Query(where, tuple(merged(order)))

    def either(self):
        parts = [self.both()]
        while self.got("||", "or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(q for p in parts for q in (p.parts if isinstance(p, Or) else (p,))))

    def both(self):
        parts = [self.negated()]
        while self.got("&&", "and"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else And(tuple(q for p in parts for q in (p.parts if isinstance(p, And) else (p,))))

    def negated(self):
        if self.got("!", "not"):
            return Not(self.negated())
        if self.got("truepredicate"):
            return Truth(True)
        if self.got("falsepredicate"):
            return Truth(False)
        if self.ahead("("):
            # Either a group of predicates or an operand in parentheses.
            start = self.at
            try:
                self.take()
                inner = self.either()
                self.need(")")
                if not (self.kind == "op" and self.word in (*COMPARE, "+", "-", "*", "/")) and not self.ahead(*WORDS, "between"):
                    return inner
            except QueryError:
                pass
            self.at = start
        return self.comparison()

    def comparison(self):
        left = self.sum()
        if self.got("between"):
            values = self.list_()
            if len(values) != 2:
                raise QueryError("Operator 'BETWEEN' requires list with 2 elements")
            return Between(left, Const(values[0]), Const(values[1]))
        if self.kind == "op" and self.word in COMPARE:
            op = COMPARE[self.take()]
        elif self.kind == "id" and self.word.lower() in WORDS:
            op = WORDS[self.take().lower()]
        else:
            raise QueryError(f"Invalid predicate: a comparison is missing at '{self.word}'")
        fold = self.kind == "fold" and bool(self.take())
        if op == "GEOWITHIN":
            return Compare(op, left, self.shape())
        right = self.sum()
        if isinstance(left, Const) and isinstance(right, Const):
            raise QueryError("Cannot compare two constants")
        if op == "IN" and isinstance(right, Const):
            raise QueryError("The right side of 'IN' must be a list")
        if fold and op in ("<", ">", "<=", ">=", "IN", "TEXT"):
            raise QueryError(f"Case insensitive comparison isn't known for '{op}'")
        return Compare(op, left, right, fold)

    # -- operands

    def sum(self):
        left = self.product()
        while self.kind == "op" and self.word in "+-":
            left = folded(self.take(), left, self.product())
        return left

    def product(self):
        left = self.operand()
        while self.kind == "op" and self.word in ("*", "/"):
            left = folded(self.take(), left, self.operand())
        return left

    def operand(self):
        if self.got("("):
            inner = self.sum()
            self.need(")")
            return inner
        quantifier = QUANTIFIERS[self.take().lower()] if self.ahead(*QUANTIFIERS) and not self.ahead(".", "[", "between", *COMPARE, *WORDS, k=1) else None
        if self.ahead("{"):
            return ListConst(tuple(self.list_()), quantifier)
        if self.kind == "arg" and not self.word.lower().startswith("$k"):
            v = self.arg()
            if isinstance(v, (list, tuple, set)):
                return ListConst(tuple(map(native, v)), quantifier)
            return Const(native(v))
        if self.ahead("subquery") and self.ahead("(", k=1):
            self.take(), self.take()
            path = self.path(None)
            self.need(",")
            name = self.take()
            if name[0] != "$":
                raise QueryError("The subquery variable must start with '$'")
            self.need(",")
            where = self.either()
            self.need(")")
            self.need(".")
            if self.take().lower() not in ("@count", "@size"):
                raise QueryError("A subquery must be followed by '.@count'")
            return SubQuery(path, name, where)
        if self.kind == "id" and not self.constant_word() or self.kind == "arg":
            return self.path(quantifier)
        return Const(self.literal())

    def constant_word(self) -> bool:
        return self.word.lower() in ("true", "false", "null", "nil") and not self.ahead(".", k=1) or (self.word.lower() in ("obj", "binary") and self.ahead("(", k=1))

    def list_(self) -> list:
        if self.kind == "arg":
            return [native(v) for v in self.arg()]
        self.need("{")
        out = []
        while not self.got("}"):
            if out:
                self.need(",")
            out.append(native(self.arg()) if self.kind == "arg" else self.literal())
        return out

    def arg(self):
        word = self.take()
        n = int(word.lstrip("$kK"))
        if n >= len(self.args):
            raise QueryError(f"Request for argument at index {n} but only {len(self.args)} are given")
        return self.args[n]

    def literal(self):
        kind, word = self.kind, self.take()
        low = word.lower()
        if kind == "int":
            return int(word)
        if kind == "hex":
            return int(word, 16)
        if kind == "float":
            return float(word.rstrip("fF"))
        if kind == "inf":
            return -math.inf if word[0] == "-" else math.inf
        if kind == "nan":
            return math.nan
        if kind == "str":
            return unquoted(word)
        if kind == "b64":
            return Binary(base64.b64decode(word[4:-1]))
        if kind == "uuid":
            return Uuid(low[5:-1])
        if kind == "oid":
            return ObjectId(low[4:-1])
        if kind == "epoch":
            s, n = word[1:].split(":")
            return Instant(int(s), int(n))
        if kind == "date":
            d = list(map(int, re.split(r"[-T@:]", word, flags=re.I)))
            if d[0] < 1900:
                raise QueryError("Dates before the year 1900 can't be written")
            return Instant(int((dt.datetime(*d[:6]) - dt.datetime(1970, 1, 1)).total_seconds()), d[6] if len(d) > 6 else 0)
        if kind == "link":
            return Key(int(word[1:]) if word[0] in "oO" else int(word.split(":")[1]))
        if kind == "id":
            if low in ("true", "false"):
                return low == "true"
            if low in ("null", "nil"):
                return None
            if low == "binary" and self.got("("):
                v = self.literal()
                self.need(")")
                return Binary(v.encode())
            if low == "obj" and self.got("("):
                cls = self.literal()
                self.need(",")
                v = native(self.arg()) if self.kind == "arg" else self.literal()
                self.need(")")
                return Key(v, cls)
        raise QueryError(f"Invalid predicate: a value is missing at '{word}'")

    def path(self, quantifier: str | None) -> Path:
        steps: list = []
        while True:
            if self.kind == "arg":  # $K0: a path given as an argument
                steps += str(self.arg()).split(".")
            elif self.kind == "id":
                steps.append(re.sub(r"\\(.)", r"\1", self.take()))
            elif steps and self.kind in ("link", "epoch"):
                steps.append(self.take())
            else:
                raise QueryError(f"Invalid predicate: a property is missing at '{self.word}'")
            while self.got("["):
                if self.ahead("first", "last", "size"):
                    word = self.take().upper()
                    steps.append("@size" if word == "SIZE" else f"[{word}]")
                elif self.got("*"):
                    steps.append("[*]")
                else:
                    v = self.arg() if self.kind == "arg" else self.literal()
                    if isinstance(v, bool) or not isinstance(v, (int, str)):
                        raise QueryError("An index must be a number or a string")
                    steps.append(("index", v) if isinstance(v, int) else ("key", v))
                self.need("]")
            if not self.got("."):
                return Path(tuple(s.lower() if isinstance(s, str) and s.startswith("@") else s for s in steps), quantifier)

    def point(self) -> tuple[float, ...]:
        self.need("[")
        out = [float(self.literal())]
        while self.got(","):
            out.append(float(self.literal()))
        self.need("]")
        return tuple(out)

    def shape(self) -> Shape:
        if self.kind == "arg":
            v = self.arg()
            if not isinstance(v, Shape):
                raise QueryError("The right side of 'GEOWITHIN' must be a shape")
            return v
        name = self.take().lower()
        self.need("(")
        if name == "geobox":
            points = (self.point(), (self.need(","), self.point())[1])
        elif name == "geocircle":
            points = (self.point(), (self.need(","), float(self.literal()))[1])
        elif name == "geopolygon":
            rings = []
            while not rings or self.got(","):
                self.need("{")
                ring = [self.point()]
                while self.got(","):
                    ring.append(self.point())
                self.need("}")
                rings.append(tuple(ring))
            points = tuple(rings)
        else:
            raise QueryError("The right side of 'GEOWITHIN' must be a shape")
        self.need(")")
        return Shape(name[3:], points)

    # -- orderings

    def ordering(self):
        word = self.take().lower()
        self.need("(")
        if word == "limit":
            n = self.literal()
            if isinstance(n, bool) or not isinstance(n, int) or n < 0:
                raise QueryError("LIMIT needs a number that isn't negative")
            self.need(")")
            return Limit(n)
        out = []
        while not out or self.got(","):
            p = self.path(None)
            out.append((p, not self.got("desc", "descending") and (self.got("asc", "ascending"), True)[1]) if word == "sort" else p)
        self.need(")")
        return Sort(tuple(out)) if word == "sort" else Distinct(tuple(out))


def merged(order: list) -> list:
    """Sorts that follow each other become one, of which the last written is the primary one."""
    out: list = []
    for o in order:
        if isinstance(o, Sort) and out and isinstance(out[-1], Sort):
            out[-1] = Sort(o.keys + out[-1].keys)
        else:
            out.append(o)
    return out


def unquoted(word: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPE.get(m[1], m[1]), word[1:-1])


def native(v):
    """An argument's value as a literal's."""
    if isinstance(v, bytes):
        return Binary(v)
    if isinstance(v, dt.datetime):
        s = (v.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        return Instant(s // 1_000_000, s % 1_000_000 * 1000)
    return v


def divide(a, b):
    """Division as predicates do it: whole numbers truncate, and saturate when divided by zero."""
    if isinstance(a, int) and isinstance(b, int):
        if b == 0:
            return -(1 << 63) if a < 0 else (1 << 63) - 1
        return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    if b == 0:
        return math.nan if a == 0 or a != a else math.copysign(math.inf, a)
    return a / b


def folded(op: str, left, right):
    """Arithmetic, done at once between constants."""
    if isinstance(left, Const) and isinstance(right, Const):
        a, b = left.value, right.value
        if not all(isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) for v in (a, b)):
            raise QueryError("Arithmetic needs numbers")
        return Const({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b)}[op]())
    return Arith(op, left, right)


def parse(text: str, args: Sequence[Any] = ()) -> Query:
    return Parser(text, args).query()

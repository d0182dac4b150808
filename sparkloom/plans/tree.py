"""Syntax tree of predicates and orderings. ``str`` of a node is predicate text that parses to the same node."""

from __future__ import annotations

import base64
import datetime as dt
import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any


class QueryError(ValueError):
    """A predicate that can't be parsed, or that asks for something its classes don't have."""


@dataclass(frozen=True)
class Binary:
    value: bytes


@dataclass(frozen=True)
class Uuid:
    value: str


@dataclass(frozen=True)
class ObjectId:
    value: str


@dataclass(frozen=True)
class Key:
    """An object of a class by its key."""

    value: Any
    cls: str | None = None


@dataclass(frozen=True)
class Instant:
    """Seconds and nanoseconds since 1970, both of one sign."""

    seconds: int
    nanos: int = 0

    @property
    def between(self) -> bool:
        """Whether it lies between two microseconds."""
        return self.nanos % 1000 != 0

    def datetime(self) -> dt.datetime:
        """The microsecond at or before it."""
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=(self.seconds * 10**9 + self.nanos) // 1000)


def quote(s: str) -> str:
    return '"' + re.sub(r'["\\]', lambda m: "\\" + m[0], s).replace("\n", "\\n") + '"'


def literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return {"inf": "+infinity", "-inf": "-infinity", "nan": "NaN"}.get(repr(v), repr(v))
    if isinstance(v, (int, Decimal)):
        return str(v)
    if isinstance(v, str):
        return quote(v)
    if isinstance(v, Binary):
        return f'B64"{base64.b64encode(v.value).decode()}"'
    if isinstance(v, Uuid):
        return f"uuid({v.value})"
    if isinstance(v, ObjectId):
        return f"oid({v.value})"
    if isinstance(v, Key):
        return f"obj({quote(v.cls)}, {literal(v.value)})" if v.cls else f"O{v.value}"
    if isinstance(v, Instant):
        return f"T{v.seconds}:{v.nanos}"
    raise QueryError(f"no literal for {type(v).__name__}")


@dataclass(frozen=True)
class Const:
    value: Any

    def __str__(self):
        return literal(self.value)


@dataclass(frozen=True)
class ListConst:
    values: tuple
    quantifier: str | None = None

    def __str__(self):
        return (f"{self.quantifier} " if self.quantifier else "") + "{" + ", ".join(map(literal, self.values)) + "}"


@dataclass(frozen=True)
class Shape:
    """A box (two corners), polygon (rings) or circle (centre, radius in radians); points are (longitude, latitude)."""

    kind: str
    points: tuple

    def __str__(self):
        p = lambda q: "[" + ", ".join(map(literal, q)) + "]"
        if self.kind == "circle":
            return f"geoCircle({p(self.points[0])}, {literal(self.points[1])})"
        if self.kind == "box":
            return f"geoBox({p(self.points[0])}, {p(self.points[1])})"
        return "geoPolygon(" + ", ".join("{" + ", ".join(map(p, r)) + "}" for r in self.points) + ")"


@dataclass(frozen=True)
class Path:
    """Steps: names, ("index", n), ("key", s), "first", "last", "all", or an operation such as "@count"."""

    steps: tuple
    quantifier: str | None = None

    def __str__(self):
        out = ""
        for s in self.steps:
            if isinstance(s, tuple):
                out += f"[{s[1]}]" if s[0] == "index" else f"[{quote(s[1])}]"
            elif s in ("[FIRST]", "[LAST]", "[*]"):
                out += s
            else:
                out += ("." if out else "") + (s if re.fullmatch(r"[@$\w]+", s) else re.sub(r"([^\w@$])", r"\\\1", s))
        return (f"{self.quantifier} " if self.quantifier else "") + out


@dataclass(frozen=True)
class SubQuery:
    path: Path
    variable: str
    where: Any

    def __str__(self):
        return f"SUBQUERY({self.path}, {self.variable}, {self.where}).@count"


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any
    fold: bool = False

    def __str__(self):
        return f"{self.left} {self.op}{'[c]' * self.fold} {self.right}"


@dataclass(frozen=True)
class Between:
    operand: Any
    low: Any
    high: Any

    def __str__(self):
        return f"{self.operand} BETWEEN {{{self.low}, {self.high}}}"


@dataclass(frozen=True)
class And:
    parts: tuple

    def __str__(self):
        return "(" + " && ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Or:
    parts: tuple

    def __str__(self):
        return "(" + " || ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Not:
    part: Any

    def __str__(self):
        return f"!({self.part})"


@dataclass(frozen=True)
class Truth:
    value: bool

    def __str__(self):
        return "TRUEPREDICATE" if self.value else "FALSEPREDICATE"


@dataclass(frozen=True)
class Sort:
    keys: tuple  # (Path, ascending)

    def __str__(self):
        return "SORT(" + ", ".join(f"{p} {'ASC' if a else 'DESC'}" for p, a in self.keys) + ")"


@dataclass(frozen=True)
class Distinct:
    paths: tuple

    def __str__(self):
        return "DISTINCT(" + ", ".join(map(str, self.paths)) + ")"


@dataclass(frozen=True)
class Limit:
    n: int

    def __str__(self):
        return f"LIMIT({self.n})"


@dataclass(frozen=True)
class Keep:
    """A caller's own row test; it has no text form."""

    test: Any

    def __str__(self):
        raise QueryError("a filter by function has no text form")


@dataclass(frozen=True)
class Restrict:
    """A predicate over what the ordering so far leaves: a query over a view."""

    where: Any

    def __str__(self):
        raise QueryError("a query over a view has no text form")


@dataclass(frozen=True)
class Within:
    """Only objects that other results hold too."""

    others: tuple

    def __str__(self):
        raise QueryError("results within others have no text form")


@dataclass(frozen=True)
class Query:
    where: Any
    order: tuple = field(default=())

    def __str__(self):
        return " ".join([str(self.where), *map(str, self.order)])

"""Predicates without text: a fluent builder of typed tests, and expressions made with Python's operators.

Both give the tree that predicate text is parsed to, so they run the same way and print as text.
"""

from __future__ import annotations

from typing import Any

from .parser import Parser, folded, native
from .tree import And, Arith, Between, Compare, Const, Key, ListConst, Not, Or, Path, QueryError, Shape, SubQuery, Truth


def _value(v: Any):
    if isinstance(v, Prop):
        return v.node
    if isinstance(v, (list, tuple, set, frozenset)):
        return ListConst(tuple(map(native, v)))
    return Const(native(v))


def path(text: str, quantifier: str | None = None) -> Path:
    p = Parser(text)
    out = p.path(quantifier)
    if p.kind != "end":
        raise QueryError(f"'{text}' is no path")
    return out


class Test:
    """A predicate; ``&``, ``|`` and ``~`` combine."""

    __test__ = False  # not a case of pytest's

    def __init__(self, node):
        self.node = node

    def tree(self):
        return self.node

    def __and__(self, other: "Test") -> "Test":
        return Test(And((self.node, other.node)))

    def __or__(self, other: "Test") -> "Test":
        return Test(Or((self.node, other.node)))

    def __invert__(self) -> "Test":
        return Test(Not(self.node))

    def __bool__(self):
        raise QueryError("Tests are combined with '&', '|' and '~'")

    def __str__(self):
        return str(self.node)


class Prop:
    """A property by its path, or arithmetic on some. Comparisons give a ``Test``."""

    def __init__(self, node: Any):
        self.node = path(node) if isinstance(node, str) else node

    def _test(self, op: str, v: Any, fold: bool = False) -> Test:
        right = _value(v)
        if isinstance(self.node, Const) and isinstance(right, Const):
            raise QueryError("Two constants can't be compared")
        return Test(Compare(op, self.node, right, fold))

    __hash__ = None

    def __eq__(self, v):
        return self._test("==", v)

    def __ne__(self, v):
        return self._test("!=", v)

    def __lt__(self, v):
        return self._test("<", v)

    def __le__(self, v):
        return self._test("<=", v)

    def __gt__(self, v):
        return self._test(">", v)

    def __ge__(self, v):
        return self._test(">=", v)

    def equal(self, v, case: bool = True):
        return self._test("==", v, not case)

    def not_equal(self, v, case: bool = True):
        return self._test("!=", v, not case)

    def begins_with(self, v, case: bool = True):
        return self._test("BEGINSWITH", v, not case)

    def ends_with(self, v, case: bool = True):
        return self._test("ENDSWITH", v, not case)

    def contains(self, v, case: bool = True):
        return self._test("CONTAINS", v, not case)

    def like(self, v, case: bool = True):
        return self._test("LIKE", v, not case)

    def fulltext(self, words: str):
        return self._test("TEXT", words)

    def is_in(self, values):
        return self._test("IN", list(values))

    def between(self, low, high):
        return Test(Between(self.node, _value(low), _value(high)))

    def is_null(self):
        return self._test("==", None)

    def is_not_null(self):
        return self._test("!=", None)

    def links_to(self, key, cls: str | None = None):
        return self._test("==", Key(key, cls))

    def geo_within(self, shape: Shape):
        return Test(Compare("GEOWITHIN", self.node, shape))

    def is_type(self, *names: str):
        return Test(Compare("IN", Path((*self.node.steps, "@type"), self.node.quantifier), ListConst(names)))

    def _step(self, *more) -> "Prop":
        return Prop(Path((*self.node.steps, *more), self.node.quantifier))

    def size(self):
        return self._step("@size")

    def count(self):
        return self._step("@count")

    def keys(self):
        return self._step("@keys")

    def values(self):
        return self._step("@values")

    def _aggregate(self, fn: str, prop: str | None):
        return self._step(fn, *(path(prop).steps if prop else ()))

    def minimum(self, prop: str | None = None):
        return self._aggregate("@min", prop)

    def maximum(self, prop: str | None = None):
        return self._aggregate("@max", prop)

    def sum(self, prop: str | None = None):
        return self._aggregate("@sum", prop)

    def average(self, prop: str | None = None):
        return self._aggregate("@avg", prop)

    def any(self):
        return Prop(Path(self.node.steps, "ANY"))

    def all(self):
        return Prop(Path(self.node.steps, "ALL"))

    def none(self):
        return Prop(Path(self.node.steps, "NONE"))

    def where(self, test: Test) -> "Prop":
        """The number of linked objects that satisfy ``test``, whose paths start at the linked class."""
        return Prop(SubQuery(self.node, "$x", _variable(test.node, "$x")))

    def __getitem__(self, at: int | str):
        return self._step(("index", at) if isinstance(at, int) else ("key", at))

    def _arith(self, op: str, v: Any, turned: bool = False):
        a, b = self.node, _value(v)
        return Prop(folded(op, b, a) if turned else folded(op, a, b))

    def __add__(self, v):
        return self._arith("+", v)

    def __sub__(self, v):
        return self._arith("-", v)

    def __mul__(self, v):
        return self._arith("*", v)

    def __truediv__(self, v):
        return self._arith("/", v)

    def __radd__(self, v):
        return self._arith("+", v, True)

    def __rsub__(self, v):
        return self._arith("-", v, True)

    def __rmul__(self, v):
        return self._arith("*", v, True)

    def __rtruediv__(self, v):
        return self._arith("/", v, True)


def _variable(node, name: str):
    """Paths of a test as paths of a subquery's variable."""
    go = lambda n: _variable(n, name)
    if isinstance(node, Path):
        return Path((name, *node.steps), node.quantifier)
    if isinstance(node, Compare):
        return Compare(node.op, go(node.left), go(node.right), node.fold)
    if isinstance(node, Between):
        return Between(go(node.operand), node.low, node.high)
    if isinstance(node, (And, Or)):
        return type(node)(tuple(map(go, node.parts)))
    if isinstance(node, Not):
        return Not(go(node.part))
    if isinstance(node, Arith):
        return Arith(node.op, go(node.left), go(node.right))
    if isinstance(node, SubQuery):
        return SubQuery(go(node.path), node.variable, node.where)
    return node


class Where:
    """Tests added one after another, all of which hold: ``Where().greater("a", 1).group().equal("b", 2).Or().equal("c", 3).end_group()``.

    ``Or`` starts an alternative of the group it stands in; ``Not`` negates the next test or group. A second argument of type
    ``Prop`` is a property of the same class.
    """

    def __init__(self):
        self._groups: list[list[list]] = [[[]]]
        self._negate: list[bool] = []
        self._not = False

    def _add(self, node) -> "Where":
        if self._not:
            node, self._not = Not(node), False
        self._groups[-1][-1].append(node)
        return self

    def _compare(self, op: str, prop: str, v: Any, case: bool = True) -> "Where":
        return self._add(Prop(prop)._test(op, v, not case).node)

    def equal(self, prop: str, v: Any, case: bool = True):
        return self._compare("==", prop, v, case)

    def not_equal(self, prop: str, v: Any, case: bool = True):
        return self._compare("!=", prop, v, case)

    def less(self, prop: str, v: Any):
        return self._compare("<", prop, v)

    def less_equal(self, prop: str, v: Any):
        return self._compare("<=", prop, v)

    def greater(self, prop: str, v: Any):
        return self._compare(">", prop, v)

    def greater_equal(self, prop: str, v: Any):
        return self._compare(">=", prop, v)

    def between(self, prop: str, low: Any, high: Any):
        return self._add(Prop(prop).between(low, high).node)

    def begins_with(self, prop: str, v: Any, case: bool = True):
        return self._compare("BEGINSWITH", prop, v, case)

    def ends_with(self, prop: str, v: Any, case: bool = True):
        return self._compare("ENDSWITH", prop, v, case)

    def contains(self, prop: str, v: Any, case: bool = True):
        return self._compare("CONTAINS", prop, v, case)

    def like(self, prop: str, v: Any, case: bool = True):
        return self._compare("LIKE", prop, v, case)

    def fulltext(self, prop: str, words: str):
        return self._compare("TEXT", prop, words)

    def is_in(self, prop: str, values: Any):
        return self._compare("IN", prop, list(values))

    def links_to(self, prop: str, *keys: Any):
        return self._add(_any([Prop(prop).links_to(k).node for k in keys]))

    def not_links_to(self, prop: str, *keys: Any):
        return self._add(Not(_any([Prop(prop).links_to(k).node for k in keys])))

    def size_equal(self, prop: str, n: Any):
        return self._add((Prop(prop).size() == n).node)

    def size_not_equal(self, prop: str, n: Any):
        return self._add((Prop(prop).size() != n).node)

    def size_less(self, prop: str, n: Any):
        return self._add((Prop(prop).size() < n).node)

    def size_less_equal(self, prop: str, n: Any):
        return self._add((Prop(prop).size() <= n).node)

    def size_greater(self, prop: str, n: Any):
        return self._add((Prop(prop).size() > n).node)

    def size_greater_equal(self, prop: str, n: Any):
        return self._add((Prop(prop).size() >= n).node)

    def size_between(self, prop: str, low: int, high: int):
        return self._add(Prop(prop).size().between(low, high).node)

    def test(self, test: Test):
        return self._add(test.node)

    def and_query(self, other: "Where"):
        return self._add(other.tree())

    def group(self):
        self._negate.append(self._not)
        self._not = False
        self._groups.append([[]])
        return self

    def end_group(self):
        if len(self._groups) < 2:
            raise QueryError("A group ends that hasn't begun")
        if self._not:
            raise QueryError("Nothing follows 'Not'")
        node = _either(self._groups.pop())
        self._not = self._negate.pop()
        return self._add(node)

    def Or(self):  # noqa: N802 - the word is taken
        if not self._groups[-1][-1]:
            raise QueryError("Nothing stands before 'Or'")
        self._groups[-1].append([])
        return self

    def Not(self):  # noqa: N802
        self._not = not self._not
        return self

    def tree(self):
        if len(self._groups) > 1:
            raise QueryError("A group hasn't ended")
        if self._not:
            raise QueryError("Nothing follows 'Not'")
        return _either(self._groups[0])

    def __str__(self):
        return str(self.tree())


def _any(nodes: list):
    return nodes[0] if len(nodes) == 1 else Or(tuple(nodes)) if nodes else Truth(False)


def _either(alternatives: list[list]):
    if len(alternatives) > 1 and not alternatives[-1]:
        raise QueryError("Nothing follows 'Or'")
    return _any([part[0] if len(part) == 1 else And(tuple(part)) if part else Truth(True) for part in alternatives])

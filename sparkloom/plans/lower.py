"""Syntax tree to DataFrame.

A predicate becomes one boolean Column over its class, with what links need joined in: a to-one step
is a left join, done once for each path; a to-many operand is a frame of its own, reduced to one row for each parent
before it is joined, so no row of the class is ever repeated. Where such an operand is a conjunct of the whole predicate,
it becomes a left semi or anti join instead. Tests keep two-valued logic; conjuncts that compare with a
literal stay in the plain form that scans push down.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, mixed, text, values
from .catalog import Catalog, Class, Property
from .tree import And, Arith, Between, Binary, Compare, Const, Instant, Key, ListConst, Not, ObjectId, Or, Path, QueryError, Shape, SubQuery, Truth, Uuid

AGGREGATES = {"@min": "min", "@max": "max", "@sum": "sum", "@avg": "avg"}
STRINGS = {"BEGINSWITH", "ENDSWITH", "CONTAINS", "LIKE", "TEXT"}
FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
_fresh = count()


def q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Scalar:
    """One value a row. via: column of the last link's target key, null where the link is; link: class linked to."""

    col: Column
    kind: str
    via: Column | None = None
    link: str | None = None
    fulltext: bool = False
    variant: Column | None = None
    terms: Column | None = None


@dataclass
class Array:
    """A list of values in a row."""

    col: Column
    kind: str
    quantifier: str | None = None
    is_map: bool = False
    via: Column | None = None


@dataclass
class Many:
    """Values of linked objects: a child frame whose __root column holds the parent's key, and the value in it."""

    frame: "Frame"
    parent: str  # column of the parent frame that __root refers to
    leaf: "Scalar | Array | None"
    quantifier: str | None = None


class Frame:
    """A DataFrame that grows by joins; columns of joined classes carry their path as prefix."""

    def __init__(self, catalog: Catalog, cls: Class, df: DataFrame, prefix: str = "", extra: tuple[str, ...] = ()):
        self.catalog, self.cls, self.df, self.base, self.joined, self.extra = catalog, cls, df, prefix, {}, extra

    # -- joins

    def follow(self, cls: Class, prefix: str, p: Property) -> tuple[Class, str]:
        """Left join the target of a to-one link, once."""
        target = self.catalog.get(p.target)
        if (prefix, p.name) not in self.joined:
            new = f"{prefix}{p.name}__"
            right = target.frame.select(*[q(c).alias(new + c) for c in target.frame.columns])
            self.df = self.df.join(right, q(prefix + p.col) == q(new + target.key), "left")
            self.joined[prefix, p.name] = new
        return target, self.joined[prefix, p.name]

    def children(self, cls: Class, prefix: str, p: Property) -> tuple[DataFrame, Class, str]:
        """(rows of linked objects with __root, their class, parent's column)."""
        if p.kind == "backlinks":
            child = self.catalog.get(p.target)
            origin = child.find(p.origin)
            if not cls.key:
                raise QueryError(f"'{cls.name}' has no key, so nothing links to it")
            root = F.explode(q(origin.col)) if origin.kind == "links" else q(origin.col)
            return child.frame.select(root.alias("__root"), "*").where("__root IS NOT NULL"), child, prefix + cls.key
        child = self.catalog.get(p.target)
        if not cls.key:
            raise QueryError(f"'{cls.name}' needs a key for its list '{p.name}'")
        links = cls.frame.select(q(cls.key).alias("__root"), F.explode(q(p.col)).alias("__to"))
        return links.join(child.frame, q("__to") == q(child.key)).drop("__to"), child, prefix + cls.key

    def expand(self, cls: Class, prefix: str, p: Property) -> tuple[Class, str]:
        """Inner join all linked objects into a child frame: a to-many step below another."""
        rows, child, parent = self.children(cls, prefix, p)
        new = f"{prefix}{p.name}__{next(_fresh)}__"
        rows = rows.select(*[q(c).alias(new + c) for c in rows.columns])
        self.df = self.df.join(rows, q(parent) == q(new + "__root")).drop(new + "__root")
        return child, new


class Lowering:
    def __init__(self, catalog: Catalog, cls: str):
        self.catalog = catalog
        self.cls = catalog.get(cls)
        self.root = Frame(catalog, self.cls, self.cls.frame)
        self.variables: dict[str, tuple[Frame, Class, str]] = {}

    # -- whole predicates

    def filtered(self, where) -> DataFrame:
        """The rows of the class that satisfy ``where``, with its own columns only at the end."""
        if self.cls.asymmetric:
            raise QueryError(f"'{self.cls.name}' is only written to")
        for part in ordered_by_cost(conjuncts(where)):
            if isinstance(part, Truth) and part.value:
                continue
            if not self.semi_join(part):
                test = self.test(self.root, self.cls, "", part, strict=False)  # may join links in first
                self.root.df = self.root.df.where(test)
        return self.root.df

    def semi_join(self, part) -> bool:
        """A conjunct over a to-many operand against a constant, as a left semi or anti join."""
        negate = False
        while isinstance(part, Not):
            part, negate = part.part, not negate
        if not isinstance(part, Compare) or not isinstance(part.left, Path) or not isinstance(part.right, (Const, ListConst)) or isinstance(part.right, ListConst) and part.right.quantifier:
            return False
        left = self.operand(self.root, self.cls, "", part.left)
        if not isinstance(left, Many) or left.leaf is None or isinstance(left.leaf, Array):
            return False
        quantifier = left.quantifier or "ANY"
        inner = self.pair(part.op, left.leaf, part.right, part.fold, strict=quantifier == "ALL", where=part)
        hit = left.frame.df.where(~inner if quantifier == "ALL" else inner).select("__root")
        how = "left_semi" if (quantifier == "ANY") != negate else "left_anti"
        self.root.df = self.root.df.join(hit.withColumnRenamed("__root", k := f"__r{next(_fresh)}"), q(left.parent) == q(k), how)
        return True

    # -- predicates

    def test(self, f: Frame, cls: Class, prefix: str, node, strict: bool = True) -> Column:
        go = lambda n, s=strict: self.test(f, cls, prefix, n, s)
        if isinstance(node, Truth):
            return F.lit(node.value)
        if isinstance(node, And):
            return balanced([go(p) for p in ordered_by_cost(node.parts)], lambda a, b: a & b)
        if isinstance(node, Or):
            return balanced([go(p) for p in as_lists(node.parts)], lambda a, b: a | b)
        if isinstance(node, Not):
            return self.negated(f, cls, prefix, node.part, strict)
        if isinstance(node, Between):
            left = self.operand(f, cls, prefix, node.operand)
            if isinstance(left, (Array, Many)) and left.quantifier != "ALL":
                raise QueryError("'BETWEEN' on a list needs 'ALL'")
            if isinstance(left, Scalar):
                # An operand is lowered once, so its links are joined once.
                return self.pair(">=", left, node.low, False, strict, node) & self.pair("<=", left, node.high, False, strict, node)
            return self.quantified(f, left, lambda x: self.pair(">=", x, node.low, False, True, node) & self.pair("<=", x, node.high, False, True, node))
        if isinstance(node, Compare):
            return self.comparison(f, cls, prefix, node, strict)
        raise QueryError(f"Not a predicate: {node}")

    def negated(self, f: Frame, cls: Class, prefix: str, node, strict: bool) -> Column:
        """Not ``node``, with the negation driven down to comparisons: ``not (x > 3)`` is ``x <= 3 or x is null``, which scans can push down."""
        if isinstance(node, Not):
            return self.test(f, cls, prefix, node.part, strict)
        if isinstance(node, (And, Or)):
            parts = [self.negated(f, cls, prefix, p, strict) for p in (as_lists(node.parts) if isinstance(node, Or) else node.parts)]
            return balanced(parts, (lambda a, b: a | b) if isinstance(node, And) else (lambda a, b: a & b))
        if isinstance(node, Compare) and isinstance(node.left, Path) and node.left.steps[-1] != "@type" and node.op in ("==", "!=", "IN", *FLIP):
            r, x = node.right, None
            if isinstance(r, Const) and r.value is not None and node.op != "IN" or isinstance(r, ListConst) and r.quantifier in (None, "ANY") and r.values and None not in r.values:
                x = self.operand(f, cls, prefix, node.left)
            if isinstance(x, Scalar) and not x.link and x.variant is None:
                test = self.pair(node.op, x, r, node.fold, False, node) if isinstance(r, Const) else self.in_list(node.op, x, r, node.fold, node, False)
                return ~test | x.col.isNull() if node.op != "!=" else ~test
        return ~self.test(f, cls, prefix, node, True)

    def comparison(self, f: Frame, cls: Class, prefix: str, node: Compare, strict: bool) -> Column:
        op, l, r = node.op, node.left, node.right
        if isinstance(l, (Const, ListConst)) and not isinstance(r, (Const, ListConst)) and op in ("==", "!=", *FLIP):
            op, l, r = FLIP.get(op, op), r, l
        if op == "GEOWITHIN":
            return self.geo(f, cls, prefix, l, r)
        if isinstance(l, Path) and l.steps[-1] == "@type" and isinstance(r, (Const, ListConst)):
            return self.by_type(f, cls, prefix, op, l, r)
        left = self.operand(f, cls, prefix, l)
        if isinstance(left, Many) and left.leaf is None:
            if isinstance(r, Const) and r.value is None:
                raise QueryError("Cannot compare a list of links with NULL")
            if isinstance(r, (Const, ListConst)):
                left.leaf = Scalar(q(left.frame.base + left.frame.cls.key), left.frame.cls.kinds[left.frame.cls.key], link=left.frame.cls.name)
        if isinstance(r, Const):
            if op in STRINGS and not isinstance(r.value, (str, Binary, type(None))):
                raise QueryError(f"Unsupported comparison operator '{op}' against type '{type(r.value).__name__}'")
            if isinstance(left, Scalar):
                return self.pair(op, left, r, node.fold, strict, node)
            return self.quantified(f, left, lambda x: self.pair(op, x, r, node.fold, True, node))
        if isinstance(r, ListConst):
            if isinstance(left, Array) and not left.quantifier and not r.quantifier and op != "IN":
                # Lists of equal length, element by element.
                other = F.array(*[self.constant(left.kind, v) for v in r.values]) if r.values else F.array().cast(f"array<{left.kind}>")
                return self.elementwise(op, left, Array(other, left.kind), node.fold)
            if isinstance(left, Scalar):
                return self.in_list(op, left, r, node.fold, node, strict)
            return self.quantified(f, left, lambda x: self.in_list(op, x, r, node.fold, node))
        right = self.operand(f, cls, prefix, r)
        if isinstance(right, Many) or isinstance(left, Many):
            return self.across(f, op, left, right, node.fold)
        if op == "IN" or isinstance(right, Array) and isinstance(left, Scalar):
            if not isinstance(right, Array):
                raise QueryError("The right side of 'IN' must be a list")
            if isinstance(left, Array):
                raise QueryError("A list can't be looked up in a list")
            flipped = "==" if op == "IN" else FLIP.get(op, op)
            return self.quantified(f, right, lambda x: self.both(flipped, x, left, node.fold))
        if isinstance(left, Array) and isinstance(right, Array):
            return self.elementwise(op, left, right, node.fold)
        if isinstance(left, Array):
            return self.quantified(f, left, lambda x: self.both(op, x, right, node.fold))
        return self.both(op, left, right, node.fold)

    def quantified(self, f: Frame, operand: Array | Many, each: Callable[[Scalar], Column]) -> Column:
        """ANY (also by default), ALL or NONE over a list or linked objects. Of nothing: false, true, true."""
        quantifier = operand.quantifier or "ANY"
        if isinstance(operand, Array):
            a = F.map_values(operand.col) if operand.is_map else operand.col
            if quantifier == "ALL":
                return F.coalesce(F.forall(a, lambda x: each(Scalar(x, operand.kind))), F.lit(True))
            some = F.coalesce(F.exists(a, lambda x: each(Scalar(x, operand.kind))), F.lit(False))
            return some if quantifier == "ANY" else ~some
        leaf = operand.leaf
        inner = each(leaf) if isinstance(leaf, Scalar) else F.coalesce(F.exists(leaf.col, lambda x: each(Scalar(x, leaf.kind))), F.lit(False))
        if isinstance(leaf, Array) and quantifier == "ALL":
            inner = F.coalesce(F.forall(leaf.col, lambda x: each(Scalar(x, leaf.kind))), F.lit(True))
        found = self.per_parent(f, operand, (F.min if quantifier == "ALL" else F.max)(inner))
        out = F.coalesce(found, F.lit(quantifier == "ALL"))
        return ~out if quantifier == "NONE" else out

    def per_parent(self, f: Frame, many: Many, agg: Column) -> Column:
        """An aggregate over linked objects, joined to their parent; null where there are none."""
        n = next(_fresh)
        reduced = many.frame.df.groupBy("__root").agg(agg.alias(f"__v{n}")).withColumnRenamed("__root", f"__k{n}")
        f.df = f.df.join(reduced, q(many.parent) == q(f"__k{n}"), "left").drop(f"__k{n}")
        return q(f"__v{n}")

    def across(self, f: Frame, op: str, left, right, fold: bool) -> Column:
        """A to-many operand against a value of the parent's row."""
        if isinstance(left, Many) and isinstance(right, Many):
            raise QueryError("Two lists of linked objects can't be compared")
        many, other = (left, right) if isinstance(left, Many) else (right, left)
        if isinstance(right, Many):
            op = FLIP.get(op, "==" if op == "IN" else op)
        if not isinstance(other, Scalar) or not isinstance(many.leaf, Scalar):
            raise QueryError("A list of linked objects is compared with one value")
        n = next(_fresh)
        mine = f.df.select(q(many.parent).alias(f"__p{n}"), other.col.alias(f"__o{n}")).distinct()
        many.frame.df = many.frame.df.join(mine, q("__root") == q(f"__p{n}"))
        if many.parent != f.base + (f.cls.key or ""):
            raise QueryError("A value of the row is only compared with objects linked from it directly")
        return self.quantified(f, many, lambda x: self.both(op, x, Scalar(q(f"__o{n}"), other.kind), fold))

    def elementwise(self, op: str, a: Array, b: Array, fold: bool) -> Column:
        same = F.size(a.col) == F.size(b.col)
        if op == "!=":
            return ~self.elementwise("==", a, b, fold)
        pairs = F.zip_with(a.col, b.col, lambda x, y: self.both(op, Scalar(x, a.kind), Scalar(y, b.kind), fold))
        return F.coalesce(same & F.forall(F.when(same, pairs), lambda t: t), F.lit(False))

    # -- comparisons of single values

    def pair(self, op: str, x: Scalar, c: Const, fold: bool, strict: bool, where=None) -> Column:
        """A value against a constant."""
        v = c.value
        if op == "TEXT":
            if not x.fulltext:
                raise QueryError("'TEXT' needs a property with full-text search")
            return text.search(x.col, v, x.terms)
        if x.link:
            if op not in ("==", "!=") or v is not None and not isinstance(v, Key) and isinstance(v, (float, bool)):
                raise QueryError("Links can only be compared with '==' and '!='")
            v = v.value if isinstance(v, Key) else v
            if v is None:
                return (x.via if x.via is not None else x.col).isNull() if op == "==" else (x.via if x.via is not None else x.col).isNotNull()
            return values.compare(op, x.col, self.constant(x.kind, v), x.kind, x.kind, strict, True)
        if x.variant is not None:
            return self.dynamic(op, x, v, fold)
        if op in ("BEGINSWITH", "ENDSWITH", "CONTAINS", "LIKE"):
            if x.kind not in ("string", "binary"):
                raise QueryError(f"Unsupported comparison operator '{op}' on type '{x.kind}'")
            return self.string(op, x.col, v, fold, x.kind, strict)
        if fold:
            if x.kind != "string":
                raise QueryError(f"Case insensitive comparison isn't known for type '{x.kind}'")
            if v is not None:
                return values.compare(op, F.lower(x.col), F.lit(v.lower()), "string", "string", strict, True)
        if v is None:
            if op in ("==", "!="):
                return x.col.isNull() if op == "==" else x.col.isNotNull()
            return x.col.isNull() if op in ("<=", ">=") else F.lit(False)
        if x.kind.startswith("timestamp") and isinstance(v, Instant) and v.between:
            # Values have microseconds: one before this instant is at or before the microsecond below it.
            if op in ("==", "!="):
                return F.lit(op == "!=")
            op = {"<": "<=", ">=": ">"}.get(op, op)
        if values.is_number(x.kind) and isinstance(v, float) and v != v:
            return F.lit(op == "!=")
        if x.kind in values.INT and isinstance(v, (float, Decimal)) and v != v // 1 or x.kind in values.INT and v in (float("inf"), float("-inf")):
            # A fraction: compare as numbers; against whole numbers it can't be equal.
            return values.compare(op, x.col, F.lit(float(v)), x.kind, "double", strict, True)
        return values.compare(op, x.col, self.constant(x.kind, v), x.kind, x.kind, strict, True)

    def in_list(self, op: str, x: Scalar, lst: ListConst, fold: bool, where, strict: bool = True) -> Column:
        """A value against a list: IN, or a comparison with any, all or none of its values. Without ``strict`` null may stand for false."""
        if op == "IN":
            op = "=="
        quantifier = lst.quantifier or "ANY"
        if op == "==" and quantifier in ("ANY", "NONE") and not fold and not x.link and x.variant is None and lst.values:
            known = [v for v in lst.values if v is not None]
            fine = [self.constant(x.kind, v) for v in known if not (x.kind in values.INT and isinstance(v, float) and v != v // 1)]
            test = x.col.isin(*fine) if fine else F.lit(False)
            if strict or quantifier == "NONE" or len(known) < len(lst.values):
                test = F.coalesce(test, F.lit(False))
            if len(known) < len(lst.values):
                test = test | x.col.isNull()
            return test if quantifier == "ANY" else ~test
        tests = [self.pair(op, x, Const(v), fold, True, where) for v in lst.values]
        if quantifier == "ALL":
            return balanced(tests, lambda a, b: a & b) if tests else F.lit(True)
        some = balanced(tests, lambda a, b: a | b) if tests else F.lit(False)
        return some if quantifier == "ANY" else ~some

    def both(self, op: str, a: Scalar, b: Scalar, fold: bool) -> Column:
        """Two values of a row."""
        if a.link or b.link:
            if op not in ("==", "!="):
                raise QueryError("Links can only be compared with '==' and '!='")
        elif not comparable(a.kind, b.kind):
            raise QueryError(f"Unsupported comparison between type '{a.kind}' and type '{b.kind}'")
        if op in ("BEGINSWITH", "ENDSWITH", "CONTAINS"):
            x, y = (F.lower(a.col), F.lower(b.col)) if fold else (a.col, b.col)
            return F.coalesce({"BEGINSWITH": F.startswith, "ENDSWITH": F.endswith, "CONTAINS": F.contains}[op](x, y), a.col.isNull() & b.col.isNull())
        if op == "LIKE":
            raise QueryError("The right side of 'LIKE' must be a constant")
        if fold:
            a, b = Scalar(F.lower(a.col), a.kind), Scalar(F.lower(b.col), b.kind)
        return values.compare(op, a.col, b.col, a.kind, b.kind)

    def string(self, op: str, x: Column, v, fold: bool, kind: str, strict: bool = True) -> Column:
        if v is None:
            return x.isNotNull() if op == "CONTAINS" and not fold else x.isNull() if op != "LIKE" else x.isNull()
        v = v.value if isinstance(v, Binary) else v.encode() if kind == "binary" else v
        if fold and isinstance(v, str):
            x, v = F.lower(x), v.lower()
        if op == "LIKE":
            test = text.like(x, v if isinstance(v, str) else v.decode())
        else:
            test = {"BEGINSWITH": F.startswith, "ENDSWITH": F.endswith, "CONTAINS": F.contains}[op](x, F.lit(v))
        return F.coalesce(test, F.lit(False)) if strict else test

    def dynamic(self, op: str, x: Scalar, v, fold: bool) -> Column:
        """A dynamic value against a constant: only values of the constant's own class can match."""
        var = x.variant
        name = mixed.type_name(var)
        if v is None:
            null = F.coalesce(name == "VOID", F.lit(True))
            return null if op == "==" else ~null if op == "!=" else null & F.lit(op in ("<=", ">="))
        if isinstance(v, bool):
            col, mine = mixed.read(var, "$", "boolean"), name == "BOOLEAN"
            out = values.compare(op, col, F.lit(v), "boolean", "boolean", True, True)
        elif isinstance(v, (int, float, Decimal)):
            mine = name.isin(*sorted(mixed.NAMES["numeric"]))
            wide = "decimal(38,10)" if isinstance(v, int) else "double"
            col = mixed.read(var, "$", wide)
            out = values.compare(op, col, F.lit(v).cast(wide), wide, wide, True, True)
        elif isinstance(v, str):
            mine, col = name == "STRING", mixed.read(var, "$", "string")
            if op in ("BEGINSWITH", "ENDSWITH", "CONTAINS", "LIKE"):
                out = self.string(op, col, v, fold, "string")
            else:
                out = values.compare(op, F.lower(col) if fold else col, F.lit(v.lower() if fold else v), "string", "string", True, True)
        else:
            raise QueryError(f"No comparison of a dynamic value with '{type(v).__name__}'")
        mine = F.coalesce(mine, F.lit(False))
        return ~mine | out if op == "!=" else mine & out

    def by_type(self, f: Frame, cls: Class, prefix: str, op: str, l: Path, r) -> Column:
        if op not in ("==", "!=", "IN"):
            raise QueryError("'@type' can only be compared with '==', '!=' and 'IN'")
        names = [r.value] if isinstance(r, Const) else list(r.values)
        for n in names:
            if not isinstance(n, str) or n.lower() not in mixed.NAMES:
                raise QueryError(f"Unable to parse the type attribute string '{n}'")
        x = self.operand(f, cls, prefix, Path(l.steps[:-1], l.quantifier))
        if isinstance(x, Array) and x.kind == "variant":
            return self.quantified(f, x, lambda e: reduce(lambda a, b: a | b, [mixed.has_type(e.col, n) for n in names]))
        if not isinstance(x, Scalar) or x.variant is None:
            raise QueryError("'@type' needs a dynamic value")
        test = reduce(lambda a, b: a | b, [mixed.has_type(x.variant, n) for n in names])
        return ~test if op == "!=" else test

    def geo(self, f: Frame, cls: Class, prefix: str, l: Path, shape: Shape) -> Column:
        path, p = self.walk_to(cls, l)
        if p.kind != "point":
            raise QueryError("'GEOWITHIN' needs a property that holds a point")
        x = self.operand(f, cls, prefix, l)
        if isinstance(x, Scalar):
            return geo.within(x.col["type"], x.col["coordinates"], shape)
        # Unlike other tests, ALL of nothing is false here.
        out = self.quantified(f, x, lambda e: geo.within(e.col["type"], e.col["coordinates"], shape))
        if x.quantifier == "ALL":
            some = self.quantified(f, Many(x.frame, x.parent, x.leaf, "ANY"), lambda e: F.lit(True)) if isinstance(x, Many) else F.coalesce(F.size(x.col) > 0, F.lit(False))
            out = out & some
        return out

    def walk_to(self, cls: Class, path: Path) -> tuple[Class, Property]:
        steps, p = self.catalog.expand(cls.name, list(path.steps)), None
        while steps and not (isinstance(steps[0], str) and steps[0].startswith(("@", "["))) and isinstance(steps[0], str):
            p = cls.find(steps.pop(0))
            if p.target and steps:
                cls = self.catalog.get(p.target)
        if p is None:
            raise QueryError(f"'{path}' is no property")
        return cls, p

    # -- operands

    def operand(self, f: Frame, cls: Class, prefix: str, node) -> Scalar | Array | Many:
        if isinstance(node, Const):
            return self.free_constant(node.value)
        if isinstance(node, Arith):
            a, b = self.operand(f, cls, prefix, node.left), self.operand(f, cls, prefix, node.right)
            for x in (a, b):
                kind = x.kind if isinstance(x, (Scalar, Array)) else x.leaf.kind if x.leaf else ""
                if not values.is_number(kind):
                    raise QueryError("Arithmetic needs numbers")
            if isinstance(a, Scalar) and isinstance(b, Scalar):
                return Scalar(*values.arithmetic(node.op, a.col, b.col, a.kind, b.kind))
            if not isinstance(a, Scalar) and not isinstance(b, Scalar):
                raise QueryError("Arithmetic between two lists isn't known")
            many = b if isinstance(a, Scalar) else a
            fn = (lambda x: values.arithmetic(node.op, a.col, x.col, a.kind, x.kind)) if many is b else (lambda x: values.arithmetic(node.op, x.col, b.col, x.kind, b.kind))
            if isinstance(many, Array):
                return Array(F.transform(many.col, lambda x: fn(Scalar(x, many.kind))[0]), fn(Scalar(F.lit(None).cast(many.kind), many.kind))[1], many.quantifier)
            if not isinstance(node.right if many is a else node.left, Const):
                raise QueryError("A list of linked objects takes part in arithmetic with constants only")
            return Many(many.frame, many.parent, Scalar(*fn(many.leaf)), many.quantifier)
        if isinstance(node, SubQuery):
            many = self.operand(f, cls, prefix, node.path)
            if not isinstance(many, Many) or many.leaf is not None:
                raise QueryError("A subquery needs a list of linked objects")
            self.variables[node.variable] = (many.frame, many.frame.cls, many.frame.base)
            test = self.test(many.frame, many.frame.cls, many.frame.base, _rooted(node.where, node.variable))
            return Scalar(F.coalesce(self.per_parent(f, many, F.count_if(test)), F.lit(0)), "bigint")
        if isinstance(node, Path):
            return self.path(f, cls, prefix, node)
        raise QueryError(f"Not an operand: {node}")

    def path(self, f: Frame, cls: Class, prefix: str, node: Path) -> Scalar | Array | Many:
        steps, via, many, home = self.catalog.expand(cls.name, list(node.steps)), None, None, f
        while steps:
            step = steps.pop(0)
            if step == "@links":
                if steps and steps[0] in ("@count", "@size"):
                    return self.all_backlinks(f, cls, prefix)
                if len(steps) < 2:
                    raise QueryError("'@links' needs a class and a property")
                origin = self.catalog.get(steps.pop(0))
                link = origin.find(steps.pop(0))
                if link.target != cls.name or link.kind not in ("link", "links"):
                    raise QueryError(f"'{origin.name}.{link.name}' doesn't link to '{cls.name}'")
                p = Property(f"@links.{origin.name}.{link.name}", "backlinks", target=origin.name, origin=link.name)
            elif isinstance(step, tuple) or step.startswith(("@", "[")):
                raise QueryError(f"Unexpected '{step}' in '{node}'")
            else:
                p = cls.find(step)
            if p.kind in ("links", "backlinks"):
                if many is None:
                    rows, child, parent = f.children(cls, prefix, p)
                    f = Frame(self.catalog, child, rows, "", ("__root",))
                    many = Many(f, parent, None, node.quantifier)
                    cls, prefix = child, ""
                else:
                    cls, prefix = f.expand(cls, prefix, p)
                    f.cls, f.base = cls, prefix
                if not steps:
                    many.frame = f
                    return many
                if steps[0] in ("@count", "@size"):
                    return Scalar(F.coalesce(self.per_parent(home, many, F.count(F.lit(1))), F.lit(0)), "bigint")
                if steps[0] in AGGREGATES:
                    leaf = self.path(f, cls, prefix, Path(tuple(steps[1:])))
                    if not isinstance(leaf, Scalar) or not (values.is_number(leaf.kind) or leaf.kind.startswith("timestamp") and steps[0] in ("@min", "@max")):
                        raise QueryError(f"Cannot use aggregate '{steps[0]}' here")
                    out = self.per_parent(home, many, values.aggregate(AGGREGATES[steps[0]], leaf.col, leaf.kind))
                    kind = leaf.kind if steps[0] in ("@min", "@max") else "double" if steps[0] == "@avg" or leaf.kind in values.REAL else "bigint" if leaf.kind in values.INT else leaf.kind
                    return Scalar(F.coalesce(out, F.lit(0).cast(kind)) if steps[0] == "@sum" else out, kind)
                continue
            if p.kind == "link":
                if not steps:
                    out = Scalar(q(prefix + p.col), cls.kinds[p.col], via=self.link_null(f, cls, prefix, p), link=p.target)
                    return self.wrapped(many, f, out)
                cls, prefix = f.follow(cls, prefix, p)
                via = q(prefix + cls.key)
                continue
            leaf = self.value(cls, prefix, p, steps, via)
            if many is None and isinstance(leaf, Array):
                leaf.quantifier = node.quantifier
            return self.wrapped(many, f, leaf)
        raise QueryError(f"'{node}' is no value")

    def wrapped(self, many: Many | None, f: Frame, leaf):
        if many is None:
            return leaf
        many.frame, many.leaf = f, leaf
        return many

    def link_null(self, f: Frame, cls: Class, prefix: str, p: Property) -> Column:
        """The key of the target, null also where no such object is there."""
        target, at = f.follow(cls, prefix, p)
        return q(at + target.key)

    def value(self, cls: Class, prefix: str, p: Property, steps: list, via: Column | None) -> Scalar | Array:
        """A property of the class's own, with the steps after it."""
        col, kind = q(prefix + p.col), cls.kinds[p.col]
        if p.kind == "mixed":
            var = col if kind == "variant" else F.try_parse_json(col)
            if steps and steps[-1] in ("@size", "@count"):
                inner = mixed.read(var, mixed.json_path(steps[:-1]), "array<variant>")
                return Scalar(F.size(inner), "int", via)
            if steps and steps[-1] == "[*]":
                return Array(mixed.read(var, mixed.json_path(steps[:-1]), "array<variant>"), "variant", via=via)
            if steps and steps[-1] in ("@keys", "@values"):
                m = mixed.read(var, mixed.json_path(steps[:-1]), "map<string,variant>")
                return Array(F.map_keys(m), "string", via=via) if steps[-1] == "@keys" else Array(F.map_values(m), "variant", via=via)
            at = mixed.read(var, mixed.json_path(steps), "variant") if steps else var
            return Scalar(at, "variant", via, variant=at)
        is_map, is_array = kind.startswith("map<string,"), kind.startswith("array<")
        inner = kind[kind.index(",") + 1 : -1] if is_map else kind[6:-1] if is_array else kind
        if p.kind == "point" or not (is_map or is_array):
            if steps and steps[0] in ("@size", "@count"):
                if kind not in ("string", "binary"):
                    raise QueryError(f"'{steps[0]}' needs a string, a binary or a list")
                return Scalar(F.octet_length(col), "int", via)
            while steps and kind.startswith("struct<") and isinstance(steps[0], str):
                name = steps.pop(0)
                fields = {x.name: x.dataType.simpleString() for x in cls.frame.schema[p.col].dataType.fields}
                if name not in fields:
                    raise QueryError(f"'{p.name}' has no property '{name}'")
                col, kind = col[name], fields[name]
            if steps:
                raise QueryError(f"'{p.name}' is no list, so it has no '{steps[0]}'")
            stored = q(prefix + cls.terms[p.name]) if p.name in cls.terms else None
            return Scalar(col, kind, via, fulltext=p.name in cls.fulltext, terms=stored)
        out = Array(col, inner, None, is_map, via)
        while steps:
            s = steps.pop(0)
            if s in ("@size", "@count"):
                return Scalar(F.coalesce(F.size(out.col), F.lit(0)) if out.via is not None else F.size(out.col), "int", via)
            if s in AGGREGATES:
                src = F.map_values(out.col) if out.is_map else out.col
                fn = AGGREGATES[s]
                k = out.kind if fn in ("min", "max") else "double" if fn == "avg" or out.kind in values.REAL else "bigint" if out.kind in values.INT else out.kind
                return Scalar(values.array_aggregate(fn, src, out.kind), k, via)
            if s == "[*]":
                continue
            if s == "@keys" and out.is_map:
                out = Array(F.map_keys(out.col), "string", via=via)
            elif s == "@values" and out.is_map:
                out = Array(F.map_values(out.col), out.kind, via=via)
            elif s == "length" and out.kind in ("string", "binary"):
                out = Array(F.transform(out.col, F.octet_length), "int", via=via)
            elif out.is_map and (isinstance(s, tuple) and s[0] == "key" or isinstance(s, str) and not s.startswith(("@", "["))):
                x = F.try_element_at(out.col, F.lit(s[1] if isinstance(s, tuple) else s))
                return Scalar(x, out.kind, via, variant=x if out.kind == "variant" else None)
            elif isinstance(s, tuple) and s[0] == "index":
                x = F.get(out.col, F.lit(s[1])) if s[1] >= 0 else F.try_element_at(out.col, F.lit(s[1]))
                return Scalar(x, out.kind, via, variant=x if out.kind == "variant" else None)
            elif s in ("[FIRST]", "[LAST]"):
                x = F.get(out.col, F.lit(0)) if s == "[FIRST]" else F.try_element_at(out.col, F.lit(-1))
                return Scalar(x, out.kind, via, variant=x if out.kind == "variant" else None)
            else:
                raise QueryError(f"'{s}' isn't known for a list")
        return out

    def all_backlinks(self, f: Frame, cls: Class, prefix: str) -> Scalar:
        total = F.lit(0).cast("bigint")
        for origin, link in self.catalog.backlinks_to(cls.name):
            p = Property(link.name, "backlinks", target=origin.name, origin=link.name)
            rows, child, parent = f.children(cls, prefix, p)
            many = Many(Frame(self.catalog, child, rows), parent, None)
            total = total + F.coalesce(self.per_parent(f, many, F.count(F.lit(1))), F.lit(0))
        return Scalar(total, "bigint")

    # -- constants

    def free_constant(self, v) -> Scalar:
        if isinstance(v, bool):
            return Scalar(F.lit(v), "boolean")
        if isinstance(v, int):
            return Scalar(F.lit(v).cast("bigint"), "bigint")
        if isinstance(v, float):
            return Scalar(F.lit(v), "double")
        if isinstance(v, Decimal):
            return Scalar(F.lit(v), "decimal(38,10)")
        if isinstance(v, str):
            return Scalar(F.lit(v), "string")
        raise QueryError(f"'{v}' can't take part in an expression")

    def constant(self, kind: str, v) -> Column:
        """A literal for comparison with a value of ``kind``; numbers in text and whole floats are converted."""
        wrong = QueryError(f"Unsupported comparison between type '{kind}' and '{v}'")
        if v is None:
            return F.lit(None).cast(kind)
        if isinstance(v, Key):
            v = v.value
        if values.is_number(kind):
            if isinstance(v, str):
                try:
                    v = int(v) if kind in values.INT else float(v)
                except ValueError:
                    raise wrong from None
            if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
                raise wrong
            if kind in values.INT:
                v = int(v)
                return F.lit(v) if kind == "bigint" or not -(1 << 31) <= v < 1 << 31 else F.lit(v).cast(kind if kind == "int" else "int")
            return F.lit(float(v)) if kind == "double" else F.lit(v).cast(kind)
        if kind == "boolean":
            if not isinstance(v, bool):
                raise wrong
            return F.lit(v)
        if kind.startswith("timestamp"):
            if isinstance(v, ObjectId):
                v = Instant(int(v.value[:8], 16))
            if not isinstance(v, Instant):
                raise wrong
            return F.lit(v.datetime().isoformat(sep=" ")).cast("timestamp_ntz").cast(kind)
        if kind == "string":
            if isinstance(v, (Uuid, ObjectId)):
                return F.lit(v.value)
            if not isinstance(v, str):
                raise wrong
            return F.lit(v)
        if kind == "binary":
            if not isinstance(v, (Binary, str)):
                raise wrong
            return F.lit(v.value if isinstance(v, Binary) else v.encode())
        raise wrong


def comparable(a: str, b: str) -> bool:
    return a == b or values.is_number(a) and values.is_number(b) or a.startswith("timestamp") and b.startswith("timestamp")


def balanced(parts: list[Column], op) -> Column:
    """A chain as a balanced tree, so that long ones don't nest deep."""
    while len(parts) > 1:
        parts = [op(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def as_lists(parts: tuple) -> list:
    """Equalities of one path in an OR chain become one IN."""
    out, by = [], {}
    for p in parts:
        if isinstance(p, Compare) and p.op == "==" and isinstance(p.left, Path) and isinstance(p.right, Const) and not p.fold and not p.left.quantifier and p.right.value is not None and not isinstance(p.right.value, Key) and not p.left.steps[-1] == "@type":
            by.setdefault(p.left, []).append(p.right.value)
        else:
            out.append(p)
    return [Compare("IN", k, ListConst(tuple(v))) if len(v) > 1 else Compare("==", k, Const(v[0])) for k, v in by.items()] + out


def conjuncts(node) -> list:
    """The parts that all have to hold, with negations driven into them."""
    if isinstance(node, And):
        return [p for part in node.parts for p in conjuncts(part)]
    if isinstance(node, Not) and isinstance(node.part, Not):
        return conjuncts(node.part.part)
    if isinstance(node, Not) and isinstance(node.part, Or):
        return [p for part in as_lists(node.part.parts) for p in conjuncts(Not(part))]
    return [node]


def cost(node) -> int:
    """Tests on the row's own columns first, full text and shapes last."""
    s = str(node) if not isinstance(node, (And, Or)) else ""
    return 3 if "GEOWITHIN" in s else 2 if " TEXT " in s else 1 if isinstance(node, (Or, Not)) else 0


def ordered_by_cost(parts):
    return sorted(parts, key=cost)


def _rooted(node, variable: str):
    """The predicate of a subquery with its variable's paths made paths of the linked class."""
    go = lambda n: _rooted(n, variable)
    if isinstance(node, Path):
        if node.steps[0] != variable:
            raise QueryError(f"A subquery's paths start with '{variable}'")
        return Path(node.steps[1:], node.quantifier)
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

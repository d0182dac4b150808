"""Comparison, arithmetic and aggregates with two-valued logic: no test is ever null unless asked to be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = {"tinyint", "smallint", "int", "bigint"}
REAL = {"float", "double"}


def is_number(kind: str) -> bool:
    return kind in INT or kind in REAL or kind.startswith("decimal")


def _nan(c: Column, kind: str) -> Column:
    return F.isnan(c) if kind in REAL else F.lit(False)


def compare(op: str, a: Column, b: Column, ka: str, kb: str, strict: bool = True, plain: bool = False) -> Column:
    """``a op b`` where null equals null and nothing else compares with null; NaN compares with nothing.

    ``plain`` says that ``b`` is a literal that is not null; without ``strict`` the result may then be null for false, in
    the form that scans can push down.
    """
    real = ka in REAL or kb in REAL
    nan = (_nan(a, ka) | _nan(b, kb)) if real else None
    if op in ("==", "!="):
        if plain and not strict and op == "==":
            return a == b
        same = a.eqNullSafe(b)
        if real:
            same = same & ~F.coalesce(nan, F.lit(False))
        return same if op == "==" else ~same
    test = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if real and not (plain and op in ("<", "<=")):  # NaN sorts above all here, so it passes no test against a literal from below
        test = test & ~nan
    if plain:
        return F.coalesce(test, F.lit(False)) if strict else test
    return F.coalesce(test, (a.isNull() & b.isNull()) if op in ("<=", ">=") else F.lit(False))


def arithmetic(op: str, a: Column, b: Column, ka: str, kb: str) -> tuple[Column, str]:
    """Result and its kind, the most general of int, float, double and decimal; whole numbers wrap, truncate and saturate at x / 0."""
    if ka in INT and kb in INT:
        a, b = a.cast("bigint"), b.cast("bigint")
        if op == "/":
            top, low = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
            zero = F.when(a.isNull() | b.isNull(), F.lit(None).cast("bigint")).when(a < 0, low).otherwise(top)
            by = F.when(b != 0, b)
            return F.when(b == 0, zero).when((a == low) & (b == -1), low).otherwise(_div(a, by)), "bigint"
        if op == "*":
            # Products beyond 64 bits are null here; sums and differences wrap.
            return F.try_multiply(a, b), "bigint"
        wide = [v.cast("decimal(20,0)") for v in (a, b)]
        return wrap(wide[0] + wide[1] if op == "+" else wide[0] - wide[1]), "bigint"
    if ka.startswith("decimal") or kb.startswith("decimal"):
        fn = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
        return fn(a.cast("decimal(38,10)"), b.cast("decimal(38,10)")), "decimal(38,10)"
    kind = "double" if "double" in (ka, kb) or op == "/" and not {ka, kb} <= {"float"} else "float"
    a, b = a.cast(kind), b.cast(kind)
    if op == "/":
        inf = F.when(a == 0, F.lit(float("nan"))).when(F.isnan(a), a).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
        return F.when(b == 0, inf.cast(kind)).otherwise(F.try_divide(a, b).cast(kind)), kind
    return {"+": a + b, "-": a - b, "*": a * b}[op], kind


def _div(a: Column, b: Column) -> Column:
    """Whole division that truncates."""
    q = (a - a % b) / b
    return F.when(F.abs(a) < (1 << 52), q.cast("bigint")).otherwise(((a - a % b).cast("decimal(20,0)") / b.cast("decimal(19,0)")).cast("bigint"))


def wrap(wide: Column) -> Column:
    """A whole decimal as a signed 64-bit number, modulo 2^64."""
    two63 = F.lit(str(1 << 63)).cast("decimal(38,0)")
    two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    wide = wide.cast("decimal(38,0)")
    return (F.pmod(wide + two63, two64) - two63).cast("bigint")


def total(x: Column, kind: str, keep: Column | None = None) -> Column:
    """Sum of the values that are neither null nor NaN: 0 of none; whole numbers wrap."""
    x = _kept(x, kind, keep)
    if kind in INT:
        return F.coalesce(wrap(F.sum(x.cast("decimal(28,0)"))), F.lit(0).cast("bigint"))
    return F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,10)" if kind.startswith("decimal") else "double"))


def aggregate(fn: str, x: Column, kind: str, keep: Column | None = None) -> Column:
    """sum, min, max or avg over rows."""
    if fn == "sum":
        return total(x, kind, keep)
    x = _kept(x, kind, keep)
    return {"min": F.min, "max": F.max, "avg": lambda v: F.avg(v.cast("double") if not kind.startswith("decimal") else v)}[fn](x)


def _kept(x: Column, kind: str, keep: Column | None) -> Column:
    test = keep
    if kind in REAL:
        test = ~F.isnan(x) if test is None else test & ~F.isnan(x)
    return x if test is None else F.when(test, x)


def array_aggregate(fn: str, a: Column, kind: str) -> Column:
    """sum, min, max or avg of a list's values that are neither null nor NaN."""
    good = F.filter(a, lambda x: x.isNotNull() & (~F.isnan(x) if kind in REAL else F.lit(True)))
    if fn in ("min", "max"):
        return (F.array_min if fn == "min" else F.array_max)(good)
    wide = "bigint" if kind in INT else kind if kind.startswith("decimal") else "double"
    s = F.aggregate(good, F.lit(0).cast(wide), lambda acc, x: (acc + x).cast(wide))
    if fn == "sum":
        return F.coalesce(s, F.lit(0).cast(wide))
    return F.when(F.size(good) > 0, s.cast("double") / F.size(good))


def order_keys(x: Column, kind: str) -> list[Column]:
    """What to sort by, ascending with nulls first, so that null comes first, then NaN."""
    return [x.isNotNull(), ~F.coalesce(F.isnan(x), F.lit(False)), x] if kind in REAL else [x]


def ordered(keys: list[tuple[Column, bool]], turned: bool = False) -> list[Column]:
    """Sort keys (expression, ascending) as Spark's; ``turned``: the other way round."""
    return [k.asc_nulls_first() if up != turned else k.desc_nulls_last() for k, up in keys]
